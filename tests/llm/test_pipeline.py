"""The pipeline's stages, each on its own input, against plain Python; and the registered queries' contracts."""

import random

import pytest
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from cohortcast.llm import bpe, mixing, toxicity
from tests.llm import brute
from tests.llm.test_models import BAD, PARTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(PARTS["aa"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 150))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if i % 11 == 0:
            words.insert(3, "token = 'a8f5f167f44f4964e6c998dee827110c'")
        docs.append((i, " ".join(words), "aa", rng.choice(["s1", "s2", "s2", None]), 0))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 460):
        docs.append((i, docs[rng.randrange(40)][1] + rng.choice(["", ".", " end"]), "aa", "s1", 0))
    docs += [(900, None, None, None, None), (901, "", "aa", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tables = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / str(n)))
        tables.append(spark.read.parquet(str(tmp_path / str(n))))
    for table in tables[:-1]:
        assert table.columns == COLUMNS
    raw, calm, single, clean, mixed, encoded = ([tuple(r) for r in t.collect()] for t in tables)

    model = toxicity.fit(docs, labels)
    want = [r for r in raw if model.score([r[1] or ""])[0] < 0.3]
    assert sorted(calm, key=str) == sorted(want, key=str) and 0.1 < 1 - len(calm) / len(raw) < 0.4

    by_id = sorted(calm)
    roots = brute.components([brute.simhash(r[1]) for r in by_id])
    assert sorted(single, key=str) == sorted((by_id[i] for i in sorted(set(roots))), key=str) and len(single) < len(calm)

    was = {r[0]: r for r in single}
    assert len(clean) == len(single)
    for r in clean:
        found = brute.secret_matches(was[r[0]][1])
        assert not brute.secret_matches(r[1])
        if found:
            assert "[secret]" in r[1] and r[2:4] == was[r[0]][2:4] and r[4] == len(r[1])
        else:
            assert r == was[r[0]]

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(tables[3]).collect()}
    words = {}
    for r in mixed:
        words[r[0]] = words.get(r[0], 0) + len(brute.words(r[1]))
    assert words == {d: n for d, n in taken.items() if n} and abs(sum(words.values()) - 1.5 * sum(len(brute.words(r[1])) for r in clean)) < 200

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = bpe.encoding(f.read(), public_tokenizers.PATTERN)
    assert sorted((r[0], enc.decode_bytes(r[4]).decode()) for r in encoded) == sorted((r[0], r[1]) for r in mixed)
    assert all(r[4] == enc.encode_ordinary(enc.decode_bytes(r[4]).decode()) and r[1] == len(r[4]) for r in encoded)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(encoded)


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_sql_of_text_operators(spark, sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    for name in ("op1_secret_scan", "op4_quality_rules", "op5_mixing"):
        df = entry.queries()[name](spark, sf_dir)
        cur = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted((str(tuple(r)) for r in df.select(*columns).collect())) == sorted(str(r) for r in cur.fetchall()), name
