import random

import pytest

from ledgerloom.llm import edits, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def count(tokenizers):
    encode = edits.encoding(tokenizers("byte_bpe_50k.tiktoken")).encode_ordinary
    return lambda text: len(encode(text))


def replaced(text, changes):
    for start, end, new in reversed(changes):
        text = text[:start] + new + text[end:]
    return text


def test_pattern_is_that_of_the_vocabulary():
    import public_tokenizers
    assert edits.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("seed", range(4))
def test_random_edits_count_as_the_whole_text_does(count, seed):
    rnd = random.Random(seed)
    for _ in range(150):
        text = "".join(rnd.choice(["a", "bc ", " ", "\n", "  ", " de", "'s", "12", " 3", "!?", "é ", "\t", " \n ", "\x1c"]) for _ in range(rnd.randint(0, 120)))
        found = edits.leaves(text, rnd.choice([3, 10, 40]))
        assert "".join(found) == text
        doc = edits.Document(text, map(len, found), map(count, found))
        for _ in range(3):  # edits of an edited document
            at = sorted(rnd.randint(0, len(text)) for _ in range(2 * rnd.randint(0, 4)))
            changes = [(at[i], at[i + 1], "".join(rnd.choice(["x", " ", "\n", "y z", " q", ""]) for _ in range(rnd.randint(0, 4)))) for i in range(0, len(at), 2)]
            text = replaced(text, changes)
            doc.apply(changes, count)
            assert "".join(doc.parts) == text
            assert doc.tree.tokens[1] == count(text) and doc.tree.chars[1] == len(text)


def test_only_touched_leaves_are_encoded_again(count):
    text = " ".join(f"word{i}" for i in range(20_000))
    found = edits.leaves(text)
    doc = edits.Document(text, map(len, found), map(count, found))
    encoded = []
    redone = doc.apply([(50_000, 50_004, "new")], lambda t: encoded.append(len(t)) or count(t))
    assert redone == sum(encoded) < 3 * edits.LEAF and doc.tree.tokens[1] == count(replaced(text, [(50_000, 50_004, "new")]))


def test_wrong_edits_are_refused(count):
    doc = edits.Document("abc def", [7], [2])
    for wrong in ([(0, 3, ""), (2, 4, "")], [(5, 9, "")], [(-1, 2, "")], [(3, 2, "")]):
        with pytest.raises(ValueError):
            edits.Document("abc def", [7], [2]).apply(wrong, count)
    assert doc.apply([(3, 3, "1"), (3, 3, "2")], count) and "".join(doc.parts) == "abc12 def"


def test_query_on_all_documents(spark, documents, count):
    found = {r["doc_id"]: r for r in queries.queries()["op5_edits"](spark, FOLDER).collect()}
    assert len(found) == documents.count()
    for r in documents.collect():
        changes = sorted(edits.cleaning(r["text"]))
        text = replaced(r["text"], changes)
        row = found[r["doc_id"]]
        assert (row["n_tokens"], row["n_edits"], row["n_chars"]) == (count(text), len(changes), len(text))


def test_odd_table(spark, odd, odd_rows, count, tokenizers):
    path = tokenizers("byte_bpe_50k.tiktoken")
    state = edits.counted(odd, path)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], sum(r["leaf_chars"])) for r in state.collect()) == sorted(
        (d or 0, count(t or ""), len(t or "")) for d, t, _ in odd_rows)
    from pyspark.sql import functions as F
    put = F.expr("array(named_struct('start', 0, 'end', 0, 'text', 'new '))").cast(edits.EDITS)
    after = edits.recounted(state.withColumn("edits", put), path).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in after) == sorted((d or 0, count("new " + (t or ""))) for d, t, _ in odd_rows)
    none = edits.recounted(state.withColumn("edits", F.lit(None).cast(edits.EDITS)), path).collect()
    assert sum(r["n_reencoded"] for r in none) == 0
    assert edits.counted(odd.limit(0), path).collect() == []


def test_cleaning():
    assert edits.cleaning("a\nb\na\n\n\n12345 a\na 9999") == [(3, 5, ""), (8, 13, "0"), (18, 22, "0")]
    assert edits.cleaning("1234\n1234\n1234") == [(4, 9, ""), (9, 14, ""), (0, 4, "0")]
