import numpy as np
import public_tokenizers

import corpus_pipeline
from folioscope.llm import bpe, common, jaccard
from folioscope.llm.blobs import whole

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert set(columns) < set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    assert out.where("n_tokens <> size(ids)").count() == 0


def test_documents_keep_their_own_lines(spark):
    passage = "\n".join(f"shared passage of the licence in {w} words" * 9 for w in ("few", "many", "plain"))
    texts = [passage, f"{passage}\nown words", f" \n{passage}\n", "", None]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    assert out == {0: (passage, len(passage)), 1: ("own words", 9), 3: ("", 0), 4: (None, None)}


def test_texts_reach_python_once(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'plain words'), (2, CAST(NULL AS STRING)), (3, ''), (4, CAST(X'61FF62' AS STRING)) AS t(doc_id, text)")
    beside, own = common.beside_text(df, "text")
    assert own == "text" and {r.doc_id: r.b for r in df.select("doc_id", beside.alias("b")).collect()} == {1: None, 2: "", 3: None, 4: "a�b"}
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN).drop("text"), ranks, public_tokenizers.PATTERN).collect()}
    assert out == {1: b"plain words", 2: b"", 3: b"", 4: "a�b".encode()}
    numbers = df.select("doc_id", df.doc_id.alias("text"))
    assert common.beside_text(numbers, "text")[1] is None
    assert [r.ids for r in bpe.encode(numbers, ranks, public_tokenizers.PATTERN).collect()] == [r.ids for r in bpe.encode(numbers.select("doc_id", numbers.text.cast("string")), ranks, public_tokenizers.PATTERN).collect()]


def test_sketch_is_small_on_the_driver(spark):
    docs = spark.createDataFrame([(k, f"a few words of document {k} and a few more") for k in range(50)], "id long, text string")
    sketch = jaccard._sketch(jaccard._facts(docs, 3).where("piece is not null").select("piece", "places", "counts"))
    assert len(sketch) == jaccard.SKETCH_PIECES and sum(map(len, sketch)) < 1 << 16
    counts = b"".join(whole(x, (1 << jaccard.SKETCH_BITS) // jaccard.SKETCH_PIECES) for x in sketch)
    assert len(counts) == 1 << jaccard.SKETCH_BITS and max(counts) == int(np.log2(51.0) * 8)


def test_codec_forgets_what_a_task_met():
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = own.encode("unquestionablyzz words").tolist()
    assert own.pieces and own.beside
    own.forget()
    assert not own.pieces and not own.beside and own.encode("unquestionablyzz words").tolist() == ids
