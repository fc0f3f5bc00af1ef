"""Each stage against a brute-force version on its own input, and the whole run."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import pieces
from tests.llm.test_benchmark import by_hand as contaminated
from tests.llm.test_passages import by_hand as removed
from tests.llm.test_simhash import by_hand as fingerprint
from tests.llm.test_simhash import groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage as rows."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in P.STAGES:
        left = stage(spark, docs, FOLDER)
        rows = left.collect()
        out.append((docs.columns, docs.collect(), left.columns, rows))
        docs = spark.createDataFrame(rows, left.schema)
    return out


def test_stages_are_the_five_in_order():
    assert [f.__name__ for _, f in P.STAGES] == ["accepted_language", "near_copies", "repeated_passages", "decontaminated", "token_ids"]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(before == after for before, _, after, _ in stages[:-1])


def test_language_keeps_texts_with_letters_unchanged(stages):
    _, before, _, after = stages[0]
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r["text"] and any(c.isalpha() for c in r["text"]))


def test_one_of_each_group_of_near_copies(stages):
    _, before, _, after = stages[1]
    stay = {c for _, _, c in groups([(r["doc_id"], fingerprint(r["text"])) for r in before])}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r["doc_id"] in stay)


def test_passages_go(stages):
    _, before, _, after = stages[2]
    wanted = removed([(r["doc_id"], r["text"]) for r in before])
    left = {r["doc_id"]: r for r in after}
    assert set(left) == {d for d, (n, gone, _) in wanted.items() if n > gone}
    for r in before:
        n, gone, _ = wanted[r["doc_id"]]
        if n > gone:
            new = left[r["doc_id"]]
            assert len(new["text"].split()) == n - gone and new["n_chars"] == len(new["text"])
            assert gone or new["text"] == r["text"]


def test_benchmark_items_go(spark, stages):
    _, before, _, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    first = {i: t.lower().split()[:3] for i, t in items}
    likely = [(r["doc_id"], r["text"]) for r in before if any(" ".join(w) in " ".join(r["text"].lower().split()) for w in first.values())]
    found = {d for d, _ in contaminated(likely, items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert found <= gone and len(gone) <= len(found) + 2
    assert all(tuple(r) in set(map(tuple, before)) for r in after)


def test_token_ids(stages, tokenizers):
    _, before, _, after = stages[4]
    sp = pieces.model(tokenizers("piece_bpe_32k.model")).library
    assert {r["doc_id"]: r["ids"] for r in after} == {r["doc_id"]: sp.encode(r["text"]) + [2] for r in before}
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_is_the_stages_in_turn(spark, stages):
    found = {r["doc_id"]: r["ids"] for r in P.run(spark, FOLDER).collect()}
    assert found == {r["doc_id"]: r["ids"] for r in stages[4][3]}


def test_stages_take_odd_and_empty_tables(spark, odd):
    docs = odd.withColumns({"n_chars": F.length("text"), "source": F.lit("s")})
    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            left = stage(spark, table, FOLDER)
            assert left.columns == docs.columns and left.count() <= table.count()
        assert P.token_ids(spark, table, FOLDER).count() == table.count()
