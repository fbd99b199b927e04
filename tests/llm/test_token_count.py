"""Compiled token counts against the tokenizer library."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pagesmith.llm import token_count  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n", "it's they're we'll 'r 'rx 'l l' ''s 'x I'VE don't! 'em", "!!!'s 's!!'re...", "''' 'll'll 'd'd'", "'",
    "<|endoftext|>a<|startoftext|><|ENDOFTEXT|> x<|endoftext", "Σίσυφος ΟΔΟΣ İstanbul ǅ ﬁ é ẛ̣", "漢字かな 한국어 😀😀 ½²③ ٣٤",
    "a\xa0b c\x1cd\x85e​f", "\x00\x01\x7f", "x" * 5000, "aaaa" * 50 + " ababab", "a" * 20001, "word " * 30000,
]


def texts():
    rnd = random.Random(1)
    mixed = lambda alphabet, most: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, most)))
    out = [mixed("abcdefghijklmnopqrstuvwxyz'  .,!<|>éüßñçаб漢0١½\ńΣA", 80) for _ in range(1500)]
    out += [mixed("abetinorsh", 60) for _ in range(1500)] + [mixed("aab", 60) for _ in range(500)]
    assigned = [*range(0x20, 0x250), *range(0x370, 0x377), *range(0x4E00, 0x9F00), *range(0x1F600, 0x1F640)]
    return ODD + out + ["".join(chr(rnd.choice(assigned)) for _ in range(30)) for _ in range(1000)]


@pytest.fixture(scope="module")
def want():
    library = tokenizers.Tokenizer.from_file(PATH)
    return lambda rows: [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    import json

    with open(PATH) as file:
        return token_count.Machine(json.load(file))


def test_counts(machine, want):
    rows = texts()
    assert machine.count(rows).tolist() == want(rows)


def test_states_may_start_anew(machine, want, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    monkeypatch.setattr(token_count, "BLOCK_CHARS", 500)
    rows = texts()[::7]
    assert machine.count(rows).tolist() == want(rows)


def test_chunk_maps_do_not_depend_on_chunks(machine, monkeypatch):
    line = " ".join(texts()[:400]) + " "
    import numpy as np

    classes = machine.cutter.classes[np.frombuffer(line.encode("utf-32-le"), np.uint32)]
    whole = machine.cutter.starts(classes).tolist()
    for chunk in (1, 2, 3, 17, 1 << 20):
        monkeypatch.setattr(token_count, "CHUNK", chunk)
        assert machine.cutter.starts(classes).tolist() == whole


def test_table(spark, want):
    rows = texts()[:60]
    data = [(i % 50, t, -1, "x") for i, t in enumerate(rows)] + [(None, None, 0, ""), (3, rows[3], 0, "")]
    table = spark.createDataFrame(data, "doc_id long, text string, n_tokens int, n_bytes string").repartition(3)
    got = token_count.count_tokens(table, PATH, limit=40)
    counts = want([t or "" for _, t, *_ in data])
    expect = [(i, len((t or "").encode()), n, n > 40) for (i, t, *_), n in zip(data, counts, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expect, key=str)
    assert token_count.count_tokens(table.limit(0), PATH).collect() == []
