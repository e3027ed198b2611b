"""The pipeline's stages: what goes, what stays, and their columns."""

import re

import corpus_pipeline as P
from nearfield.llm.common import read_table, staged


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = staged(stage(spark, docs, sf_dir))
        assert out.columns == columns and out.dtypes == docs.dtypes
        assert out.count() <= docs.count()
        seen[name] = out
        docs = out
    assert seen["ngram_jaccard"].count() < seen["toxicity"].count()
    masked = {r["doc_id"]: r["text"] for r in seen["secrets"].collect()}
    before = {r["doc_id"]: r["text"] for r in seen["decontamination"].collect()}
    assert set(masked) == set(before)
    assert not any(re.search(r"AKIA[A-Z0-9]{16,}", t or "") for t in masked.values())
    assert all(masked[i] == t for i, t in before.items() if t and not re.search(r"[A-Za-z0-9+/=_-]{20}|pass|secret|token|key", t, re.I))
    mixed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert set(columns) <= set(mixed.columns)
    assert mixed.where("taken <= 0").count() == 0


def test_clashing_columns_stay(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = read_table(spark, sf_dir, "documents").where("doc_id < 60").withColumns({c: F.col("doc_id") + 7 for c in ("score", "Spans", "items", "base", "size", "draw", "class")})
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = staged(stage(spark, out, sf_dir))
    assert out.columns == docs.columns
    assert out.where("score <> doc_id + 7 or spans <> doc_id + 7 or size <> doc_id + 7 or class <> doc_id + 7").count() == 0 and out.count() > 0
    assert P.STAGES[-1][1](spark, out, sf_dir).where("taken > 0").count() > 0


def test_runs_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(table):
    return sorted(map(str, table.collect()))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_near_copies_leave_one_row_a_group(spark, sf_dir):
    """Repeated and null ids, null and empty texts: against a plain version of the stage."""
    base = " ".join(f"w{k}" for k in range(60))
    near = base + " more"
    texts = [(1, base), (1, base), (None, base), (5, near), (5, "another text that stands under the id five"), (None, near), (7, None), (7, None), (None, None), (8, ""), (9, "one"), (10, "one"), (None, "only without an id"), (None, "only without an id"), (11, base.upper())]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, sf_dir).collect()]
    want = [(1, base), (5, "another text that stands under the id five"), (7, None), (7, None), (None, None), (8, ""), (9, "one"), (None, "only without an id")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_near_copies_equal_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    some = docs.collect()
    sets = []
    for r in some:
        w = words(r["text"])
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(some)))
    for x in range(len(some)):
        for y in range(x):
            same = len(sets[x] & sets[y])
            if same and 100 * same >= 80 * (len(sets[x]) + len(sets[y]) - same) and group[x] != group[y]:
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, some):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = {r["doc_id"] for g, r in zip(group, some) if r["doc_id"] == least[g]}
    assert {r["doc_id"] for r in P.drop_near_copies(spark, docs, sf_dir).collect()} == want and len(want) < len(some)


def test_cutting_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in read_table(spark, d, "benchmark").where("text is not null and item_id is not null").collect():
        w = word.findall(lower(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}
    got = {r["doc_id"]: r["text"] for r in P.cut_benchmark(spark, docs, d).collect()}
    cut = 0
    for r in docs.collect():
        spans = [(m.start(), m.end()) for m in word.finditer(lower(r["text"] or ""))]
        w = [lower(r["text"])[a:b] for a, b in spans]
        hit = {p for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit:
            assert got[r["doc_id"]] == r["text"]
            continue
        cut += 1
        out, at, p = "", 0, 0
        while p < len(w):
            if p in hit:
                out += r["text"][at : spans[p][0]]
                while p < len(w) and p in hit:
                    p += 1
                at = spans[p][0] if p < len(w) else spans[-1][1]
            else:
                p += 1
        out += (r["text"] or "")[at:]
        assert got.get(r["doc_id"], "") == out or not out.strip()
    assert cut > 3


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_toxic_stage_equals_the_scores(spark):
    from nearfield.llm import queries as Q

    d = "/root/testdata/sf0.01"
    docs = read_table(spark, d, "documents")
    clean = {r["doc_id"] for r in Q.op6_toxicity(spark, d).collect() if r["score"] < 0.5}
    assert {r["doc_id"] for r in P.drop_toxic(spark, docs, d).collect()} == clean and len(clean) < docs.count()


def test_masking_equals_the_spans(spark):
    from nearfield.llm import queries as Q

    sf_dir = "/root/testdata/sf0.01"
    docs = read_table(spark, sf_dir, "documents")
    spans = {r["doc_id"]: r["spans"] for r in Q.op10_secrets(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in P.mask_secrets(spark, docs, sf_dir).collect()}
    masked = 0
    for i, text in texts.items():
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in spans[i].split(",") if x):
            if int(a) >= at:
                out += text[at : int(a)] + f"<{kind}>"
                masked += 1
            at = max(at, int(b))
        assert got[i] == (None if text is None else out + text[at:])
    assert masked > 5


def test_mixing_equals_sql(spark, sf_dir):
    import duckdb

    from nearfield.llm import queries as Q

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r[4] for r in con.execute(Q.ORACLES["op7_mix_sources"]).fetchall() if r[4]}
    got = {r["doc_id"]: r["taken"] for r in P.mix_sources(spark, read_table(spark, sf_dir, "documents"), sf_dir).collect()}
    assert got == want


def test_edge_rows_through_all_stages(spark, sf_dir):
    """Null, empty, very long and repeated rows, null ids and sources, and clashing names, through every stage."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{k}" for k in range(60_000))
    some = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t", "en", None, 2), (4, long, "en", "a", len(long)), (5, long + " end", "en", "a", 9), (None, "no id at all", "en", "a", 12), (None, "no id at all", "en", "a", 12), (6, "one", "en", "a", 3), (6, "one", "en", "a", 3), (7, "x" * 300_000, "en", "b", 300_000)]
    docs = spark.createDataFrame(some, DOCS).withColumns({c: F.lit(3) for c in ("score", "_score", "_own_score", "Items", "key", "row", "_key", "number", "start")})
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = staged(stage(spark, out, sf_dir))
        assert out.columns == docs.columns and out.where("score <> 3 or _score <> 3 or _own_score <> 3 or Items <> 3 or key <> 3").count() == 0
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in out.where("doc_id is not null").collect()) == [(1, 0), (2, 0), (3, 2), (4, len(long)), (6, 3), (7, 300_000)]
    assert out.where("doc_id is null").count() == 1
    mixed = P.STAGES[-1][1](spark, out, sf_dir)
    assert 0 < mixed.count() <= out.count()


def test_staged_tables_go(spark, sf_dir):
    """After each operator only the tables that its result is read from are left below the shared folder; so it is after all stages."""
    import os

    from nearfield.llm import queries as Q

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/nearfield"
    stays = {"op1_ngram_jaccard": 1, "op7_mix_sources": 3, "op9_multi_index": 1, "pipeline": 3}
    for name, query in [*Q.QUERIES.items(), ("pipeline", P.run)]:
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        query(spark, sf_dir)
        after = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        assert len(after - before) == stays.get(name, 0), name
