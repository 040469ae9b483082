"""What the operators hold and do in a worker, and that results don't depend on how it is divided."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from driftwell.llm import bpe, infra, packing, wordhash


def test_words_hold_no_long_numbers_for_each_byte(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randrange(1, 30) for _ in range(rng.randrange(400))).encode() for _ in range(1500)] + [b"y" * 300_000 + b" z"]
    size = sum(map(len, texts))
    tracemalloc.start()
    whole = wordhash.Words(texts, lower=True).hash
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * size, (peak, size)  # a long number for each byte, and its powers, would be 40 and more
    for stretch in (1, 1000, 1 << 30):
        monkeypatch.setattr(wordhash, "STRETCH", stretch)
        assert np.array_equal(wordhash.Words(texts[-300:], lower=True).hash, whole[-len(wordhash.Words(texts[-300:], lower=True).hash) :])
    assert len(wordhash.Words([]).hash) == len(wordhash.Words([b" \n"]).hash) == 0


class _Frame:
    """Takes the place of a DataFrame whose partition is given."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_gathered_records_are_sent_in_parts():
    rng = np.random.default_rng(2)
    rows = [(src, key, rng.bytes(20_000)) for src in range(30) for key in (-1 - src, *range(40))]
    cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
    whole = pa.RecordBatch.from_arrays(cols, names=["src", "key", "data"])
    sent = list(infra.gathered(_Frame())(whole.slice(i, 100) for i in range(0, len(rows), 100)))
    assert all(b.nbytes < infra._SENT + (1 << 20) for b in sent) and len(sent) > 3
    got = {k: (src, data) for k, src, data in infra.by_key(iter(sent), 10)}
    for key in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == key]
        assert got[key][1] == b"".join(r[2] for r in own)
        assert got[key][0].tolist() == ([] if key < 0 else np.repeat([r[0] for r in own], 2000).tolist())
    assert list(infra.gathered(_Frame())(iter([]))) == []


def test_new_pieces_are_encoded_together():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    own, rng, calls = packing._ByteBPE(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3), []
    quick = own.quick
    own.quick = lambda t: calls.append(t) or quick(t)
    texts = [" ".join("".join(rng.choice("abcdefgh,.é漢0'") for _ in range(rng.randrange(1, 12))) for _ in range(400)) for _ in range(50)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in own.lib.encode_batch(texts, add_special_tokens=False)]
    assert len(calls) <= 2 * len(texts) + 1  # the first and last piece of each text, and the rest
    assert own.encode(texts) == got and len(calls) <= 2 * len(texts) + 1


def test_new_words_are_proposed_together(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib, rng = bpe.WordBPE(path), Tokenizer.from_file(path), random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 20))) for _ in range(2000)]
    words = list(dict.fromkeys([*words, *("".join(chr(rng.randrange(0x250, 0x3000)) for _ in range(5)) for _ in range(200)), "!" * 40, "\0", "x", "e" * 300, "漢" * 30]))
    raw = [w.encode() for w in words]
    flat, owner = own.propose(np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw))))
    for i, w in enumerate(raw):
        assert flat[owner == i].tolist() == (own.greedy("".join(own.symbols[c] for c in w) + "\0") or [])
    assert len(own.propose(np.zeros(0, np.uint8), np.zeros(0, np.int64))[0]) == 0
    calls, alone = [], own.greedy
    monkeypatch.setattr(own, "greedy", lambda w: calls.append(w) or alone(w))
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(w) > bpe.WALKING for w in calls) and len(calls) < 5  # long words alone
