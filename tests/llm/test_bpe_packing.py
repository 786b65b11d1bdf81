import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenloom.llm import bpe, packing

VOCABULARY = os.path.join(bpe.TOKENIZERS, bpe.BYTE_BPE_50K)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.read_ranks(VOCABULARY))


def plain(coder, text):
    """BPE by its definition, word by word."""
    ranks = coder.transducer.ranks
    return [ranks[p] for word in bpe.regex.findall(bpe.SPLIT, text) for p in coder.transducer.merged(word.encode())]


SAMPLES = ["", " ", "Hello world", "a  b   c", "tabs\t\tand\nnew\r\nlines  \n", "it's we'll I'M", "12345 67 x9", "naïve café 北京大学 привет 🙂👨‍👩‍👧", "<|endoftext|> text", "  x\u0085", "a" * 300, "é" * 50, " \x1c y \x1f", "trailing "]


@needs_vocabulary
@pytest.mark.parametrize("text", SAMPLES)
def test_transducer_equals_definition(coder, text):
    assert list(coder.ids(text)) == plain(coder, text)


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc etaoin shrdlu 0123456789 '\n\t  .,-"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_transducer_on_any_text(text):
    coder = _shared()
    assert list(coder.ids(text)) == plain(coder, text)
    assert _decoded(coder, list(coder.ids(text)), 3) == text


_CODER = []


def _shared():
    if not _CODER:
        _CODER.append(bpe.Encoder(bpe.read_ranks(VOCABULARY)))
    return _CODER[0]


def _decoded(coder, ids, step):
    decoder = bpe.StreamingDecoder(coder.transducer.tokens)
    return "".join([*(decoder.push(ids[i : i + step]) for i in range(0, len(ids), step)), decoder.close()])


@needs_vocabulary
def test_against_public_library(coder):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=coder.transducer.ranks, special_tokens={})
    for text in [*SAMPLES, "The council of Brinorcas approved 71372.60 crowns; see page 12." * 20]:
        assert list(coder.ids(text)) == own.encode_ordinary(text)


def test_streaming_decoder_state():
    tokens = {0: b"\xe2", 1: b"\x82", 2: b"\xac", 3: b"x", 4: b"\xff"}
    d = bpe.StreamingDecoder(tokens)
    assert [d.push([i]) for i in (0, 1, 2, 3)] == ["", "", "€", "x"]
    assert d.push([0, 3]) == "�x" and d.push([4]) == "�"
    assert d.push([0]) == "" and d.close() == "�" and d.close() == ""


@needs_vocabulary
def test_corpus(spark):
    rows = [(1, "Hello  world\n", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello  world\n", "x"), (4, "word " * 20_000, "long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()]
    assert len(got) == 5 and dict(got)[2] == [] and dict(got)[3] == []
    assert got[0] == got[3]
    assert {r.doc_id: r.n_tokens for r in bpe.encode_corpus(df, lengths_only=True).collect()}[4] == len(dict(got)[4])
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert back[1] == "Hello  world\n" and back[2] == "" and back[4] == "word " * 20_000
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def place_by_rule(sizes, capacity):
    """Sum of squares by trying every choice; the fill levels after each item."""
    open_, history = [], []
    for size in sizes:
        def cost(levels):
            counts = {}
            for level in levels:
                if level < capacity:
                    counts[level] = counts.get(level, 0) + 1
            return sum(v * v for v in counts.values())

        options = [(cost([*open_, size]), 1, 0, None)]
        for i, level in enumerate(open_):
            if level < capacity and level + size <= capacity:
                options.append((cost([*open_[:i], level + size, *open_[i + 1 :]]), 0, -level, i))
        best = min(options, key=lambda o: o[:3])
        if best[3] is None:
            open_.append(size)
        else:
            open_[best[3]] += size
        history.append(sorted(open_))
    return history


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30), st.just(12))
def test_sum_of_squares_rule(sizes, capacity):
    packer, history = packing.SumOfSquares(capacity), []
    for size in sizes:
        packer.place(size)
        history.append(sorted(packer.levels))
    assert history == place_by_rule(sizes, capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.integers(1, 25))
def test_packing_is_whole(sizes, capacity):
    got = packing.pack(sizes, capacity)
    assert (got.groupby("container")["size"].sum() <= capacity).all()
    for item, size in enumerate(sizes):
        own = got[got["item"] == item].sort_values("piece")
        assert own["size"].sum() == size and len(own) == max(1, math.ceil(size / capacity))
        assert own["start"].tolist() == [i * capacity for i in range(len(own))]
    if len(got):
        assert sorted(got["container"].unique()) == list(range(got["container"].nunique()))


def test_pack_corpus(spark):
    sizes = spark.createDataFrame([(i, (i * 37) % 150) for i in range(500)] + [(900, None), (901, 0)], "doc_id bigint, n_tokens int")
    capacities = spark.createDataFrame([(1, 100), (2, 1000), (3, 0), (4, None)], "capacity_id int, capacity_tokens int")
    packed = packing.pack_corpus(sizes, capacities, shard_items=200)
    rows = packed.collect()
    assert {r.capacity_id for r in rows} == {1, 2}
    assert {r.doc_id for r in rows if r.capacity_id == 1} == {r.doc_id for r in sizes.collect()}
    assert {tuple(r) for r in packing.pack_corpus(sizes.repartition(3), capacities, shard_items=200).collect()} == {tuple(r) for r in rows}
    report = {r.capacity_id: r for r in packing.fill_report(packed, capacities).collect()}
    checks = {r.capacity_id: tuple(r)[1:] for r in packing.packing_checks(packed, capacities).collect()}
    assert checks == {1: (502, 0, 0, 0), 2: (502, 0, 0, 0)}
    assert report[1].fill > 0.9 and report[1].containers >= report[1].least_containers
    assert packing.pack_corpus(sizes.limit(0), capacities).count() == 0
    assert packing.pack_corpus(sizes, capacities.limit(0)).count() == 0


@needs_vocabulary
def test_long_stretches_are_not_remembered():
    coder = bpe.encoder(bpe.read_ranks(VOCABULARY))
    text = "short words " + "x" * 30_000 + " " + "\u6587" * 5_000
    ids = list(coder.ids(text))
    assert ids == list(coder.ids(text))
    assert all(max(map(len, m), default=0) <= bpe.LONGEST_REMEMBERED for m in (coder._stretches, coder._after_blank, coder._words))
