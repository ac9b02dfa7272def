"""Quality rules against a plain implementation."""

import re
from collections import Counter

from errata.llm import quality as q
from errata.llm.common import written

SF = "/root/testdata/sf0.001"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    inside = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines))


def bucket(v):
    shift = max(0, v.bit_length() - (q.SKETCH_BITS + 1))
    return v >> shift << shift


def verdicts(rows):
    """kept of each (lang, source, text), by exact counts per group."""
    base = [counts(t) for _, _, t in rows]
    failed = [c[0] < q.MIN_WORDS or 100 * c[4] > q.MAX_REPEAT_PERCENT * c[0] for c in base]
    feats = [None if f else {"symbols": 10000 * c[2] // c[0], "dup_lines": 10000 * c[3] // c[5], "repeats": 10000 * c[4] // c[0],
                             "word_len": 10000 * c[1] // c[0]} for c, f in zip(base, failed)]

    good = [i for i, f in enumerate(failed) if not f]

    def limits(members):
        out = {}
        for f, (_, upper, lower, k, least, low) in q.RULES.items():
            weight = Counter()
            for i in members:
                weight[bucket(feats[i][f])] += len(good)
            for i in good:
                weight[bucket(feats[i][f])] += q.PRIOR
            total, at, cum = sum(weight.values()), {}, 0
            for v in sorted(weight):
                cum += weight[v]
                for p in (lower, upper):
                    if cum * 100 >= total * p:
                        at.setdefault(p, v)
            spread = k * max(at[upper] - at[lower], least)
            out[f] = (at[lower] - spread if low else -1, at[upper] + spread)
        return out
    groups = {}
    for i in good:
        groups.setdefault(rows[i][:2], []).append(i)
    own = {g: limits(m) for g, m in groups.items()}
    return [not f and all(lo <= feats[i][x] <= hi for x, (lo, hi) in own[rows[i][:2]].items()) for i, f in enumerate(failed)]


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: (*counts(r.text)[:5], k) for r, k in zip(rows, verdicts([(r.lang, r.source, r.text) for r in rows]))}
    got = {r.row.doc_id: (*[r[c] for c in q.COUNTS], r.kept) for r in q.judged(docs, docs.columns).collect()}
    assert got == want


def test_groups_adapt_and_edge_rows(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    signs = " ".join(f"word{i}&" for i in range(60))
    rows = [("en", "code", signs)] * 60 + [("en", "news", plain)] * 60 + [("en", "news", signs), (None, None, plain), ("en", None, None),
            ("en", "news", ""), ("en", "news", "\t\x0b" + plain + " x"), ("en", "news", "a b c " * 40), ("en", "tiny", signs)]
    df = spark.createDataFrame([(i, *r, 1, "w") for i, r in enumerate(rows)],
                               "doc_id long, lang string, source string, text string, n_words int, row string")
    got = {r.row.doc_id: (*[r[c] for c in q.COUNTS], r.kept) for r in q.judged(df, df.columns).collect()}
    want = verdicts(rows)
    assert got == {i: (*counts(r[2])[:5], want[i]) for i, r in enumerate(rows)}
    assert got[0][-1] and not got[120][-1]  # usual among code, not among news
    assert q.quality_filter(df).columns == df.columns
    assert q.quality_filter(df).count() == sum(want)


def _limits(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    sketch = written(q.sketches(q.base_counts(df, ["doc_id", *q.GROUP])), "test-sketch")
    return {r.source: r.asDict() for r in q.thresholds(sketch).collect()}


def test_limits_follow_the_upper_tail(spark):
    """Two groups alike but for their tail have different limits, and a limit moves with its tail."""
    plain = [" ".join(f"word{(i * j) % 997}" for i in range(1, 80 + j)) for j in range(1, 201)]
    tail = [" ".join(f"word{i}&" if i % 3 else f"word{i}" for i in range(80 + j)) for j in range(40)]
    lines = ["\n".join(" ".join(f"w{j}x{i}y{k}" for i in range(9)) for k in [*range(12), *range(3)]) for j in range(12)]
    rows = [("en", "a", t) for t in plain] + [("en", "b", t) for t in plain[:150] + tail + lines] + [("en", "b", plain[3])] * 3
    one = _limits(spark, rows)
    assert one["b"]["hi_dup_lines"] > one["a"]["hi_dup_lines"]
    more = _limits(spark, rows + [("en", "a", t) for t in tail * 3])
    assert more["a"]["hi_symbols"] > one["a"]["hi_symbols"]


def test_limits_differ_in_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = q.thresholds(written(q.sketches(q.base_counts(docs, ["doc_id", *q.GROUP])), "test-sketch")).collect()
    for f in ("dup_lines", "repeats", "word_len"):
        assert len({r[f"hi_{f}"] for r in table}) > 3


def test_every_rule_rejects(spark):
    plain = [" ".join(f"word{(i * j) % 997}" for i in range(1, 80 + j)) for j in range(2, 302)]
    bad = {"symbols": " ".join(f"word{i}&%" for i in range(80)), "word_len": " ".join("x" * 40 + str(i) for i in range(80)),
           "dup_lines": "\n".join(f"alpha{i} beta{i} gamma{i} delta{i}\n!" for i in range(12)),
           "repeats": " ".join([f"some w{i}" for i in range(40)] + ["one two three four five six seven"] * 4)}
    rows = [("en", "s", t) for t in [*plain, *bad.values()]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    found = q.judged(df, df.columns).collect()
    assert not any(r.base_failed for r in found)
    got = {r.row.doc_id: r.kept for r in found}
    assert all(got[i] for i in range(300)) and not any(got[300 + i] for i in range(4))
    assert [got[i] for i in range(304)] == verdicts(rows)


def test_very_long_text_and_line(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [("en", "s", long), ("en", "s", "\n".join(["abc d"] * 10_000)), ("en", "s", "y" * 100_000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    assert [r.kept for r in q.judged(df, df.columns).orderBy("row.doc_id").collect()] == verdicts(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x " * 60)] * 3, "doc_id long, text string")
    assert q.quality_filter(df).count() == 0
    assert q.judged(df.withColumns({"lang": q.F.lit(None).cast("string"), "source": q.F.lit("s")}), ["doc_id", "lang", "source"]).count() == 3
    assert q.quality_filter(df.limit(0)).count() == 0
