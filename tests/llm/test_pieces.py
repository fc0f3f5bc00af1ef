import hashlib
import random

import pytest

from ledgerloom.llm import pieces, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path(tokenizers):
    return tokenizers("piece_bpe_32k.model")


def test_documents(spark, documents, path):
    sp = pieces.model(path).library
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.queries()["op10_pieces"](spark, FOLDER).collect()}
    wanted = {}
    for r in documents.collect():
        ids = sp.encode(r["text"] or "") + [sp.eos_id()]
        wanted[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert found == wanted


def test_texts_of_all_kinds(path, monkeypatch):
    m = pieces.model(path)
    rnd = random.Random(8)
    texts = ["", " ", "  a", "a ", "a  b   c ", "\n\n x", "▁▁ a▁b", "😀 ñ café́", "a" * 3000, "ab" * 2000, "<s> </s> <unk> <0x0A>", "\t\tq", "x\0y",
             "漢字かな交じり文", "123 45.6,78", " \n \n", " nb sp", "the" * 300, "�‍", "½ ﬁ É é"]
    texts += ["".join(rnd.choice("aeiou bcdt ▁\n.é漢") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    texts.append("".join(rnd.choice("abcdefgh") for _ in range(20_000)))
    wanted = m.library.encode(texts)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 100)
    for n in (1, 7, len(texts)):
        assert [x.tolist() for i in range(0, len(texts), n) for x in m.encode(texts[i:i + n])] == wanted


def test_odd_table(odd, odd_rows, path):
    sp = pieces.model(path).library
    rows = pieces.encoded(odd, path, decode=True).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in rows) == sorted(
        (str(d), (ids := sp.encode(t or "") + [2]), sp.decode(ids)) for d, t, _ in odd_rows)
    back = pieces.decoded(pieces.encoded(odd, path), path).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r["doc_id"]), r["decoded"]) for r in rows)
    assert pieces.encoded(odd.limit(0), path).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.Model(str(tmp_path / "none.model"))
