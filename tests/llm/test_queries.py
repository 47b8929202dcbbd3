"""Registered queries against their SQL, and the pipeline against its stages in plain Python."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmur.llm import base, bpe, mixing, registry, secrets, toxicity
from tests.conftest import DATA, canonical
from tests.llm import common
from tests.llm.test_operators import pfair, plain_groups


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    want = duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert canonical(rows) == canonical([tuple(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in r) for r in want[columns].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_one_row_per_row(spark, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    table = "pages" if name == "op9_warc" else "documents"
    assert got.count() == spark.read.parquet(f"{DATA}/sf0.001/{table}.parquet").count()


def test_contract_columns(spark):
    need = {
        "op2_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3_near_dup": "doc_id n_shingles component_id kept", "op4_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op5_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op8_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op9_warc": "page_id payload_bytes payload_digest record_type refers_to", "op10_toxicity": "doc_id held_out score predicted",
    }
    for name, columns in need.items():
        assert set(columns.split()) <= set(registry.QUERIES[name](spark, f"{DATA}/sf0.001").columns), name


def test_pipeline(spark):
    folder = f"{DATA}/sf0.01"  # the smallest table with secrets
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]
    docs = base.table(spark, folder, "documents")
    model = toxicity.fit(docs, base.table(spark, folder, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    keep = {i for i, (_, _, kept) in plain_groups(texts, 5, 80).items() if kept}
    texts = [(i, t) for i, t in texts if i in keep]
    # spans come from the operator, which has tests of its own; masking is redone here
    found = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(found, secrets.fit(found, base.table(spark, folder, "labels"))).collect()}
    masked = {}
    for i, t in texts:
        out, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                out += t[at : s.start] + "[secret]"
            at = max(at, s.end)
        masked[i] = out + t[at:]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in masked.items()}
    import tiktoken

    ranks, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert all(r.n_tokens == len(library.encode_ordinary(masked[r.doc_id])) for r in rows)
    assert any(spans.values()) and bad and len(keep) < len(docs.collect()) - len(bad)
    # the places of the mixture, by a plain schedule of the rows that are left
    parts = mixing.shares(mixing.WEIGHTS, mixing.OTHER_WEIGHT, 1000)
    slots = {}
    for slot, i in enumerate(pfair(list(parts.values()))):
        slots.setdefault(list(parts)[i], []).append(slot)
    source = {r.doc_id: r.source for r in docs.collect()}
    streams, want = {}, {}
    for i in sorted(masked, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        streams.setdefault(source[i] if source[i] in parts else mixing.OTHER, []).append(i)
    for stream, ids in streams.items():
        for n, i in enumerate(ids):
            block = n // mixing.BLOCK
            want[i] = (block // parts[stream] * 1000 + slots[stream][block % parts[stream]]) * mixing.BLOCK + n % mixing.BLOCK
    assert {r.doc_id: r.mix_position for r in rows} == want
    assert [r.mix_position for r in rows] == sorted(want.values())


def test_mixture_holds_over_many_files(spark, tmp_path):
    """Files are read back in the reader's order; the places in the result are the mixture's all the same."""
    docs = base.table(spark, f"{DATA}/sf0.01", "documents")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        mixed = base.written(corpus_pipeline.mix_sources(spark, docs, ""), "test")
        assert len(mixed.inputFiles()) == 8
        by_file = {}
        for r in mixed.selectExpr("_metadata.file_name f", "_metadata.row_index i", "doc_id").collect():
            by_file.setdefault(r.f, []).append((r.i, r.doc_id))
        place = {r.doc_id: r.mix_position for r in mixing.mix(docs, mixing.WEIGHTS).collect()}
        assert [place[i] for f in sorted(by_file) for _, i in sorted(by_file[f])] == sorted(place.values())
        out = base.written(corpus_pipeline.encode(spark, mixed, ""), "test")
        assert {r.doc_id: r.mix_position for r in out.collect()} == place
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_encoding_follows_the_order_that_mixing_hands_on(spark, tmp_path):
    """Any other order of the same rows, over files of several sizes, gives that order and other places, not the mixture's found anew."""
    docs = base.table(spark, f"{DATA}/sf0.001", "documents").orderBy(F.desc("doc_id"))
    pdf = docs.toPandas()
    cut = [0, 20, 27, 150, len(pdf)]
    for k, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
        spark.createDataFrame(pdf[lo:hi], docs.schema).coalesce(1).write.parquet(str(tmp_path / str(k)))
        (tmp_path / "all").mkdir(exist_ok=True)
        for f in (tmp_path / str(k)).glob("*.parquet"):
            f.rename(tmp_path / "all" / f.name.replace("part-00000", f"part-{99998 + k:05d}"))  # 100000 comes after 99999
    other = spark.read.parquet(str(tmp_path / "all"))
    parts = mixing.shares(mixing.WEIGHTS, mixing.OTHER_WEIGHT, 1000)
    slots = {}
    for slot, i in enumerate(pfair(list(parts.values()))):
        slots.setdefault(list(parts)[i], []).append(slot)
    counts, want = {}, {}
    for i, s in zip(pdf.doc_id, pdf.source, strict=True):
        s = s if s in parts else mixing.OTHER
        n = counts[s] = counts.get(s, -1) + 1
        block = n // mixing.BLOCK
        want[i] = (block // parts[s] * 1000 + slots[s][block % parts[s]]) * mixing.BLOCK + n % mixing.BLOCK
    # a table that was read, and frames whose partitions have an order but whose files have none or another
    mixed = {r.doc_id: r.mix_position for r in mixing.mix(docs, mixing.WEIGHTS).collect()}
    for frame, places, order in ((other, want, list(pdf.doc_id)), (docs, want, list(pdf.doc_id)), (corpus_pipeline.mix_sources(spark, other, ""), mixed, sorted(mixed, key=mixed.get))):
        rows = corpus_pipeline.encode(spark, frame, "").collect()
        assert [r.doc_id for r in rows] == order
        assert {r.doc_id: r.mix_position for r in rows} == places


def test_runs_of_one_large_file_are_split(spark, monkeypatch):
    monkeypatch.setattr(base, "RUN", 16)
    docs = base.table(spark, f"{DATA}/sf0.001", "documents")
    mixed = base.written(corpus_pipeline.mix_sources(spark, docs, "").withColumnRenamed("lang", "_metadata").coalesce(1), "test")
    runs = base.ordered(mixed, "doc_id").groupBy("run").count().collect()
    assert len(runs) == -(-docs.count() // 16) and max(r["count"] for r in runs) == 16
    place = {r.doc_id: r.mix_position for r in mixing.mix(docs, mixing.WEIGHTS).collect()}
    assert [(r.doc_id, r.mix_position) for r in corpus_pipeline.encode(spark, mixed, "").collect()] == sorted(place.items(), key=lambda x: x[1])


def test_one_row_of_a_repeated_document_stays(spark):
    rng = common.random.Random(3)
    t, u = common.sentence(rng, 80), common.sentence(rng, 70)
    rows = [(1, t, "en"), (1, t, "en"), (1, t, "de"), (2, t + " x", "en"), (3, u, "en"), (3, "other words " + t[::-1], "en"), (None, u, "en"), (None, u, "en"), (4, None, None), (4, None, None), (5, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = sorted((r.doc_id or 0, r.text or "", r.lang or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    three = min((x for x in (u, "other words " + t[::-1])), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert out == sorted([(0, u, "en"), (0, u, "en"), (1, t, "de"), (3, three, "en"), (4, "", ""), (5, "", "en")])


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    docs = common.repeated(common.documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    common.labels(spark, 20).write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, common.empty(docs)):
        now = base.written(table, "test")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "bpe":
                assert out.dtypes == docs.dtypes, name
            now = base.written(out, "test")
        assert (now.count() == 0) == (table is not docs)


def test_the_rest_imports_without_this_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("murmur/**/*.py"), root / "bench.py", *root.glob("tests/*.py")]:
        if "llm" in path.parts:
            continue
        names = [n for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, (ast.Import, ast.ImportFrom)) for n in ([node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names])]
        assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


