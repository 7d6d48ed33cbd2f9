"""SentencePiece encoding by prefix tables against the library."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from pointloom.llm import pieces, queries

PATH = queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "▁", "▁▁ a▁", "\n", "\n\na", "a\n b \n", "x\x00y", "🦙🦙é", "<s><unk><0x41>", "\ufeff\u200b", "e\u0301", " " * 70 + "word" + " " * 33]


def test_every_text_is_encoded_as_by_the_library():
    model, rng = pieces.Model(PATH), random.Random(5)
    own = [p.replace("▁", " ") for p in model.id_of]
    few = ["a", "b", "t", "h", "in", " ", "  ", "▁", "\n", "é", "🦙", "\x00", "1", "."]
    texts = ODD + ["".join(rng.choice(own if k % 2 else few) for _ in range(rng.randrange(14))) for k in range(6000)]
    assert [model.encode(t) for t in texts] == model.library.encode(texts)
    assert model.decode([model.encode(t) for t in texts]) == [t.replace("▁", " ") for t in texts]


def test_pairs_are_compatible_just_when_merging_leaves_them_apart():
    model, rng = pieces.Model(PATH), random.Random(6)
    ids = list(model.id_of.values())
    blanks = [i for p, i in model.id_of.items() if set(p) == {"▁"}]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(a, b) for a in blanks for b in blanks]
    for a, b in pairs:
        merged = model._merged(model.piece[a] + model.piece[b])
        assert model.compatible(a, b) == (merged == [model.piece[a], model.piece[b]]), (model.piece[a], model.piece[b])


def test_long_texts_without_blanks_and_small_memories(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    many = " ".join("".join(rng.choice("abc") for _ in range(9)) for _ in range(3000))
    model = pieces.Model(PATH)
    assert model.encode(text) == model.library.encode(text)
    monkeypatch.setattr(pieces, "REMEMBERED", 2000)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    small = pieces.Model(PATH)
    assert small.encode(many) == model.library.encode(many)
    assert len(small.words) < 20 and len(small.pairs) <= 10


def test_output_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_IDS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array(["a b c d", None, "e"])], ["doc_id", "text"])
    out = list(pieces._coded(PATH)(iter([batch])))
    assert [b.num_rows for b in out] == [1, 2]
    assert [r for b in out for r in b.column(2).to_pylist()] == ["a b c d", "", "e"]


def test_rows_of_any_kind(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, "twice", "x"), (3, "twice", "x"), (None, "no id", "x"), (9, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, pieces.code(docs, PATH).collect()), key=repr)
    lib = pieces.Model(PATH).library
    assert got == sorted([(i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t, _ in rows], key=repr)
    assert pieces.code(docs.where("false"), PATH).collect() == []


def test_registered_query_equals_the_library_on_all_documents(spark, sf_dir):
    lib = pieces.Model(PATH).library
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {i: (len(e := lib.encode(t)), sha(",".join(map(str, e))), sha(lib.decode(e))) for i, t in docs}
