import pyarrow as pa

from riskframe.llm import packing
from riskframe.llm.common import byte_slices
from riskframe.llm.queries import TOKENIZER
from riskframe.llm.tokens import Encoder


def test_packing_encodes_little_at_once(spark, monkeypatch):
    sizes = []

    def watched(batch, column, n_bytes=None, *rest):
        for part in byte_slices(batch, column, n_bytes or 8 << 20, *rest):
            sizes.append((n_bytes, part.num_rows))
            yield part

    monkeypatch.setattr(packing, "byte_slices", watched)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    found = {}

    class Table:
        def select(self, *cols):
            return self

        def mapInArrow(self, fn, schema):
            texts = ["word " * 200_000] * 3 + ["", "b"]          # 1 MB each
            found["out"] = list(fn(iter([pa.record_batch([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])])))

    packing.cut_documents(Table(), TOKENIZER, 4096, 8, 2, "doc_id", "text")
    assert [n for _, n in sizes] == [2, 3] and all(b <= 2 << 20 for b, _ in sizes)
    ids = [x for b in found["out"] for x in b.column("doc_id").to_pylist()]
    assert sorted(set(ids)) == [0, 1, 2, 3, 4]


def test_latin_words_ask_the_model_alone():
    enc = Encoder(TOKENIZER)
    library, asked = enc.tok, []

    class Watched:
        model = library.model

        def encode(self, text, **how):
            asked.append(text)
            return library.encode(text, **how)

    enc.tok = Watched()
    latin = [x for x in map(chr, range(0x80, 0x250)) if x.isalpha() and x != "İ" and x.lower() < "\u0250"]
    texts = ["Été naïve ÇA straße œuvre ª º", " ".join(f"a{x}z" for x in latin), "l'été m² x½ 3ème"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in enc.encode_many(texts[:2])] == want[:2] and not asked
    assert enc.encode_many(texts[2:])[0].tolist() == want[2] and asked
