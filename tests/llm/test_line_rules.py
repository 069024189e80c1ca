"""Counts and verdicts against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from facsimile.llm.line_rules import judge_lines

SCHEMA = "doc_id long, text string, source string, host string, words string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, max_docs=3):
    holders, members, out = defaultdict(set), defaultdict(set), []

    def normal(line):
        return re.sub("[0-9]", "0", " ".join(WORD.findall(line.lower())))

    for i, t, host, *_ in rows:
        members[host].add((i, t or ""))
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[host, normal(line)].add((i, t))
    for i, t, host, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = defaultdict(list)
        for p in range(len(words) - 7):
            seen[tuple(words[p : p + 8])].append(p)
        covered = {q for ps in seen.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        left = sum(
            len(WORD.findall(x)) for x in lines
            if not (len(holders[host, normal(x)]) > max_docs and 1000 * len(holders[host, normal(x)]) > len(members[host]))
        )
        kept = not failed and 2 * left >= len(words)
        symbols = len(re.findall("[#*$%&|<>]", t))
        out.append((str(i), len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed, kept))
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcé#1", k=rng.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(15) for _ in range(3)]
    rows = []
    for i in range(60):
        own = [line(rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.6:
            own.append(rng.choice(shared).upper() + "  ")
        if rng.random() < 0.3 and own:
            own += [own[0]] * rng.randint(1, 4)
        rows.append((i, "\n".join(own), rng.choice(["h1", "h2", None]), "x", "y"))
    long = " ".join(word() for _ in range(5000)) + " a" * 2000
    rows += [(70, None, "h1", "x", "y"), (None, shared[0], "h1", "x", "y"), (71, "\t\x0b \n", None, "x", "y"), (72, long, "h2", "x", "y")]
    rows += [rows[5]] * 2 + [(73, "\x1c word " * 30, "h1", "x", "y")]
    got = judge_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), max_docs=3).collect()
    assert sorted(
        (str(r.row.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got
    ) == brute(rows)
    assert {(r.row.host, r.row.words) for r in got} == {("x", "y")}


def test_no_python(spark):
    docs = spark.createDataFrame([(1, "a", "h", "x", "y")], SCHEMA)
    plan = judge_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark):
    assert judge_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_are_removed(spark):
    """Texts without their boilerplate lines, line by line; the other lines as they were."""
    rng = random.Random(8)
    shared = ["Page 12 of  90", "all rights reserved", "\u00c9dition du jour"]
    rows = []
    for i in range(40):
        lines = [f"own {i} {chr(97 + k % 26)}{chr(97 + i % 26)}" for k in range(rng.randint(0, 3))] + ["", " \t"]
        lines += [x.upper().replace("1", str(rng.randint(0, 9))) + " " for x in shared if rng.random() < 0.5]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h2", None]), "x", "y"))
    rows += [(50, None, "h1", "x", "y"), (51, "", "h1", "x", "y"), (52, "\n\n", "h2", "x", "y"), rows[3]]
    rows += [(None, rows[4][1], host, "x", "y") for host in ("h1", "h2", None, "alone")]  # one text on several hosts
    normal = lambda line: re.sub("[0-9]", "0", " ".join(WORD.findall(line.lower())))
    holders = defaultdict(set)
    for i, t, host, *_ in rows:
        for line in filter(WORD.search, (t or "").split("\n")):
            holders[host, normal(line)].add((i, t))
    want = []
    for i, t, host, *_ in rows:
        clean = "\n".join(x for x in (t or "").split("\n") if not (WORD.search(x) and len(holders[host, normal(x)]) > 5))
        n = len(WORD.findall(t or ""))
        want.append((str(i), clean, round((n - len(WORD.findall(clean))) / n, 9) if n else 0.0))
    assert sum(c != (t or "") for (_, t, *_), (_, c, _) in zip(rows, want)) > 20
    got = judge_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), max_docs=5, min_words=1).collect()
    assert sorted((str(r.row.doc_id), r.clean_text, round(r.removed_share, 9)) for r in got) == sorted(want)


def test_limit_is_the_same_on_large_hosts(spark):
    """Eleven holders are above the limit of ten on a host of 12,000 documents as on one of 20."""
    docs = spark.range(12_020).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("own line "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"),
                 F.when((F.col("id") < 11) | (F.col("id") >= 12_009), "\nthe same footer").when(F.col("id") < 21, "\na rarer footer").otherwise("")).alias("text"),
        F.when(F.col("id") < 12_000, "large").otherwise("small").alias("source"),
    )
    cut = judge_lines(docs, min_words=1).filter(F.instr("clean_text", "\n") == 0).filter("removed_share > 0")
    assert sorted(r.doc_id for r in cut.select("row.doc_id").collect()) == [*range(11), *range(12_009, 12_020)]
