"""Packing, chat formatting, byte pairs and media: round trips against plain implementations."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosemill.llm import byte_pairs, chat, media, packing
from prosemill.llm import queries as Q

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


AWKWARD = ["", " ", "a" * 700, "\n\n  \t x", "don't we'll", "é" * 90, "日本語テキスト" * 30, "\U0001f600‍\U0001f600", "ab" * 200, "\x00\x01", "x" * 257, "1234567890" * 40, "<|endoftext|>"]


def test_ids_are_the_librarys(codec, library):
    rng = random.Random(4)
    texts = AWKWARD + ["".join(rng.choice("abcdeéß日 \n'.,0123ABC") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    ids, sizes = codec.encode(texts)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [library.encode_ordinary(t) for t in texts]
    data, _ = codec.decode(ids)
    assert data.tobytes() == "".join(texts).encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_round_trips(codec, library, text):
    ids, _ = codec.encode([text])
    assert ids.tolist() == library.encode_ordinary(text) and codec.decode(ids)[0].tobytes() == text.encode()


def test_long_pieces_merge_in_the_same_order(codec):
    for piece in ("a" * 600, "abcab" * 120, "é" * 300, "xyzzy" * 77):
        raw = piece.encode()
        out = [None]
        codec.merge_matrix([raw], len(raw), [0], out)
        assert codec.merge_long(raw).tolist() == out[0].tolist()


def test_encoding_edges(edges, empty):
    rows = [r for r in byte_pairs.decode(byte_pairs.encode(edges, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()]
    want = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in edges.collect()), key=str)
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in rows), key=str) == want
    assert byte_pairs.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- Chat ----


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=20) | st.sampled_from(["user", "a\nb", "<|im_end|>", "\\n"]), st.text(max_size=30) | st.sampled_from(["<|im_end|>\n", "<\\|", "<\\\\|im_start|>", "<", "<|"])), max_size=5))
def test_turns_read_back(turns):
    formatted = "".join(chat.render(role, text)[0] for role, text in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns


def test_plain_turns_stay_plain_and_broken_ones_are_refused():
    assert chat.render("user", "a < b | c")[0] == "<|im_start|>user\na < b | c<|im_end|>\n"
    for broken in ("x", "<|im_start|>user\nno end", "<|im_start|>user<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(broken)


def test_chat_query(spark, small):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    conflict = "<|im_end|><|im_start|>assistant ok"
    turns += [(-1, 0, "user", conflict), (-1, 1, "assistant", conflict)]
    by_id = defaultdict(list)
    for row in sorted(turns):
        by_id[row[0]].append(row[2:])
    done = Q.op8_chat_formatting(spark, small).collect()
    assert len(done) == len(by_id)
    for r in done:
        own = by_id[r["conv_id"]]
        loss = "".join(t or "" for role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{a}\n{b or ''}\n" for a, b in own).encode()))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss.encode()))


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "tie"), (1, None, "assistant", "x"), (None, 1, "user", "\U0001f600<|im_end|>"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as turns", "3 as conv")
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert back == {1: [("assistant", "x"), ("", "tie"), ("user", "")], None: [("user", "\U0001f600<|im_end|>")], 2: [("assistant", ""), ("assistant", "")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- Packing ----


def pack_checked(rows, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return pieces, len(sequences)


def test_packing(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    pieces, n = pack_checked(Q.op6_packing(spark, small).collect(), 1024)
    total = 0
    for doc_id, text in ((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(ids[at : at + r["length"]].tobytes()), len(ids))
            at += r["length"]
        assert at == len(ids)
        total += at
    assert n * 1024 < 1.03 * total + 1024


def test_packing_edges(edges, empty):
    rows = packing.pack(edges, FILE, 16).collect()
    assert len({r["sequence_id"] for r in rows}) and packing.pack(empty, FILE).count() == 0
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edges.collect()}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_place_every_piece(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = defaultdict(int)
    for p in patterns:
        assert sum(n * k for n, k in p.lengths) <= 64
        for n, k in p.lengths:
            placed[n] += k * p.packs
    assert placed == histogram
    ranges = defaultdict(list)
    for length, low, high, *_ in packing.intervals(patterns):
        ranges[length].append((low, high))
    for length, found in ranges.items():
        assert [low for low, _ in sorted(found)] == [0, *[h for _, h in sorted(found)[:-1]]] and sorted(found)[-1][1] == histogram[length]


def test_the_fast_encoder_is_the_library():
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(FILE), AWKWARD + ["a <|endoftext|> b"]
    assert packing.byte_level_ranks(FILE) and packing.byte_level_ranks(public_tokenizers.path("word_bpe_49k.json")) is None
    assert [x.tolist() for x in packing.encoder(FILE)(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


# ---- Media ----


def test_media(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    by_text = {}
    for r in Q.op10_media_columns(spark, small).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(payload) + 44, sha(media.wav(payload)))
        assert by_text.setdefault(raw, r["feature"]) == r["feature"]


def test_media_edges(edges, empty):
    done = media.read_media(media.store_media(edges))
    assert done.count() == edges.count() and media.read_media(media.store_media(empty)).count() == 0
    by_id = {r["doc_id"]: r for r in done.collect()}
    assert bytes(by_id[1]["payload"]) == bytes(by_id[2]["payload"]) == b"\xff" * 576 and by_id[1]["fingerprints"] == []


def test_fingerprints_follow_a_shift_in_time():
    rng = np.random.default_rng(7)
    tone = lambda: sum(np.sin(np.arange(576) * f) for f in rng.uniform(0.1, 3, 3))
    wave_form = np.concatenate([tone() for _ in range(40)])
    samples = np.clip(128 + 30 * wave_form, 0, 255).astype(np.uint8).tobytes()
    plain = media.fingerprints(samples)
    assert (np.diff(plain) >= 0).all() and len(plain) > 100
    later = media.fingerprints(b"\x80" * 5760 + samples)
    codes = lambda x: {(int(v) >> 40, int(v) & (2**40 - 1)) for v in x}
    moved = {(t + 20, c) for t, c in codes(plain)}
    assert len(moved & codes(later)) > 0.9 * len(moved)


def test_peaks_far_apart_are_paired():
    """Noise, a long silence, noise: the pair that spans it is there, with its distance."""
    noise = np.random.default_rng(2).integers(0, 256, 576 * 8).astype(np.uint8).tobytes()
    found = media.fingerprints(noise + b"\x80" * (288 * 3000) + noise)
    between = found & (2**22 - 1)
    assert between.max() > 2900 and (np.diff(found) >= 0).all()
    first = int(found[between.argmax()]) >> 40
    assert first < 20 and (int(found[between.argmax()]) >> 31) & 511 < 289 and (int(found[between.argmax()]) >> 22) & 511 < 289


@pytest.mark.parametrize("piece", [b"a" * 1_000_000, b"abab" * 3000 + b"b", bytes(random.Random(1).choices(b"etaoinshrdlu", k=30_000)), b"the" * 500 + b"thing" * 500])
def test_long_pieces_are_the_librarys(codec, library, piece):
    assert codec.merge_long(piece).tolist() == library._encode_single_piece(piece)
