"""What a worker holds for one step is gone when it turns to the next."""

import pickle

import pyarrow as pa

from prefscan.llm import packing, tokens


def test_an_encoder_travels_without_what_it_holds():
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = ["some text, and some more"]
    ids = enc.encode(texts)
    other = pickle.loads(pickle.dumps(enc))  # as a broadcast sends it
    assert enc.pieces and not other.pieces and not other.words
    assert other.encode(texts) == ids


def test_no_encoder_outlives_its_step(spark):
    docs = spark.createDataFrame([(i, f"text {i} and more") for i in range(40)], "doc_id long, text string").repartition(4)
    assert packing.pack(docs).count() == 40

    def held(batches):
        import gc

        from prefscan.llm import tokens
        gc.collect()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x) is tokens.Encoder for x in gc.get_objects())]})
    # another step in the workers that packed
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
