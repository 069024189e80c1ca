"""Fingerprints and components against brute force."""

import random
import re

import xxhash

from facsimile.llm.components import components
from facsimile.llm.simhash import fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, print string, component_id long"


def brute_print(text, words=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    parts = re.findall("[^\x20\x09-\x0d]+", low)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    group = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def texts(rng):
    word = lambda: "".join(rng.choices("abcdEÉ", k=rng.randint(1, 6)))
    out = ["", None, " \t\n", "one", "one two", "One Two three", "a b c", "x\x1cy z w"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        out.append(" ".join(base))
        for _ in range(4):
            changed = list(base)
            changed[rng.randrange(len(base))] = word()
            out.append("  ".join(changed))
    return out + [out[9]] * 3


def test_fingerprints():
    for t in texts(random.Random(1)):
        assert fingerprint((t or "").encode(), 3) % 2**64 == brute_print(t or "")


def test_classes(spark):
    made = texts(random.Random(2))
    rows = [(i + 10, t, "p", 1) for i, t in enumerate(made)] + [(None, made[11], "p", 1), (12, made[2], "p", 1)]
    prints = [brute_print(r[1] or "") for r in rows]
    group = brute_components(set(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    smallest = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            smallest[group[p]] = min(r[0], smallest.get(group[p], r[0]))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.row.doc_id), r.print % 2**64, r.component_id) for r in got) == sorted(
        (str(r[0]), p, smallest[group[p]]) for r, p in zip(rows, prints)
    )
    assert {r.row.print for r in got} == {"p"}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(1, i) for i in range(2, 60)]
    extra = [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    links = chain + hub + extra + [(500, 500)] + chain[:3]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    pairs = set(links) | {(b, a) for a, b in links}
    want = brute_components(sorted(nodes), lambda a, b: (a, b) in pairs)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
