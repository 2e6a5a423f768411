"""Small corpora with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(70), say(120)
    near = base.split(" ")
    near[60] = "changed"
    long = say(30_000)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 4),
        (4, "one", "en", "b", 3),
        (5, "two words", "en", "b", 9),
        (6, "three little words", "en", "b", 18),
        (7, base, "en", "a", len(base)),
        (8, base, "en", None, len(base)),
        (9, " ".join(near), "en", "a", 1),
        (10, base.upper(), "en", "c", 1),
        (11, f"{say(40)} {passage} {say(40)}", "en", "a", 1),
        (12, f"{say(55)} {passage} {say(20)}", "en", "a", 1),
        (13, f"{say(5)} {passage}", "en", "a", 1),
        (14, long, "en", "d", len(long)),
        (15, "x" * 50_000, "en", "d", 50_000),
        (None, say(60), "en", "a", 1),
        (16, "a\u00a0b\u2003c <|endoftext|> d", "en", "a", 5),
        (17, "idiot " + say(30), "en", "a", 1),
    ]
    rows += [rows[6]] * 2 + [rows[3]]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def clashing(df):
    """The same rows with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "digest", "key", "size", "token", "node", "component", "doc", "_id", "_key", "bin", "rank", "group", "a", "b", "score", "row", "own", "gone", "_copies", "_size", "source_size"]
    return df.withColumns({n: F.lit(n) for n in names})


def family(seed: int, n: int = 120) -> list[tuple]:
    """Random documents with families of near copies, shared passages and exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(3000)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = say(60)
    rows, bases = [], [say(rng.randint(20, 150)) for _ in range(6)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.75:
            w = say(rng.randint(0, 40)) + passage + say(rng.randint(0, 40))
        else:
            w = say(rng.randint(0, 90))
        rows.append((i * 3 + 1, " ".join(w), "en", f"src{i % 4}", len(w)))
    return rows


def shingle_sets(rows, n: int) -> dict:
    out = {}
    for i, t, *_ in rows:
        w = words(t, lower=True)
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def components(sets: dict, num: int, den: int) -> dict:
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
