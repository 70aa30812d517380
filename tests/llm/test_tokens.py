import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from corvina.llm import sp_viterbi, vector_pack
from hypothesis import given, settings
from hypothesis import strategies as st

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "  ", "   a", "a  b", "a   \n  b", "\n\n x", "hello▁world", "日本語 テキスト🙂 x", " " * 15, "x" + " " * 15 + "y", " " * 20 + "zz", "a" * 600, "é́ \u0000 \t\tfoo", "<s> </s> <unk> <0x0A>",
    "don't WON'T İstanbul ΣΑΣ ﬁn", "<|endoftext|> x<|ENDOFTEXT|>y", "a,b. c., 12.5% ...", " em　wide\x1cfs\x85nel",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def split(values, counts):
    return [x.tolist() for x in np.split(values, np.cumsum(counts)[:-1])]


def test_viterbi_equals_the_library(library):
    model = sp_viterbi.pieces(MODEL)
    ids, counts = model.encode(pa.array(HARD))
    assert split(ids, counts) == library.encode(HARD)
    assert model.decode(ids, counts) == library.decode(library.encode(HARD))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeinrst  \n.▁"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_random_texts(texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, counts = sp_viterbi.pieces(MODEL).encode(pa.array(texts, pa.string()))
    assert split(ids, counts) == lib.encode(texts)


def test_decoding_of_any_ids(library):
    lists = [[], [1, 2], [0, 300, 301], [3 + 0xC3, 3 + 0xA9], [3 + 0xC3, 300], [3 + 0xFF, 3 + 0xFE]]
    model = sp_viterbi.pieces(MODEL)
    got = model.decode(np.array(sum(lists, [])), np.array([*map(len, lists)]))
    assert got == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([1]))


def test_encode_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(None, None, None), (3, HARD[3], "x")]
    got = sp_viterbi.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got.collect()) == sorted((i if i is not None else -1, library.encode(t or "")) for i, t, _ in rows)
    assert {r.text for r in sp_viterbi.decode(got, MODEL).collect()} == {(t or "").replace("▁", " ") for _, t, _ in rows}
    assert sp_viterbi.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def model_file(path, kind, fallback=False, rule=None, pieces=()):
    """A small model made of given pieces, with the library's default normalisation if a rule is named."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    if rule:
        model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True).serialized_model_proto())
    else:
        model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, fallback
    specials = [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256 if fallback else 0))]
    for name, score, code in [*((n, 0.0, c) for n, c in specials), *((p, x, 1) for p, x in pieces)]:
        made = model.pieces.add()
        made.piece, made.score, made.type = name, score, code
    path.write_bytes(model.SerializeToString())
    return str(path)


PARTS = ["▁", "a", "b", "c", "x", "▁a", "ab", "bc", "abc", "▁ab", "ca", "xx", "xxxx", "fin", "f", "i", "n", "fi", "1", "cab", "▁x", "▁▁"]


@pytest.mark.parametrize(("kind", "fallback", "rule"), [(k, f, r) for k in (1, 2) for f in (False, True) for r in (None, "nmt_nfkc")])
def test_other_models(tmp_path, kind, fallback, rule):
    import sentencepiece

    pieces = [(p, -float(i % 7) - i / 16 - len(p) / 4 if kind == 1 else -float(i)) for i, p in enumerate(PARTS) if not (rule and p == "▁▁")]
    path = model_file(tmp_path / "m.model", kind, fallback, rule, pieces)
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), sp_viterbi.pieces(path)
    rng = np.random.default_rng(5)
    texts = ["", "中文中文", "a中 中b", "  ﬁn  a ① ", "\n\n", "x" * 700, "abc" * 300 + "中" * 300] + ["".join(rng.choice(list("aabbcx  中fin1é"), rng.integers(1, 400))) for _ in range(60)]
    ids, counts = model.encode(pa.array(texts))
    assert split(ids, counts) == lib.encode(texts)


def test_a_very_long_word(library):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrd▁日é0"), n)) for n in (257, 5000, 120_000)]
    ids, counts = sp_viterbi.pieces(MODEL).encode(pa.array(words))
    assert split(ids, counts) == library.encode(words)


def reference_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_word_ids_equal_the_tokenizer():
    texts = [t for t in HARD]
    for group in (texts, [t for t in texts if "<|" not in t]):
        ids, counts = vector_pack.token_ids(pa.array(group), WORDS)
        assert split(ids, counts) == reference_ids(group)


def check_packing(rows, texts, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, want in texts.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(parts) <= limits.segments
    return [sum(r.length for r in parts) for parts in by_sequence.values()]


def test_packing(spark):
    words = ["alpha", "beta", "gamma,", "delta.", "Épsilon"]
    texts = {i: " ".join(words[(i * k) % 5] for k in range(1, (i * 97) % 900 + 1)) for i in range(150)} | {900: "", 901: "x " * 9000}
    ids = dict(zip(texts, ([*x, 2] for x in reference_ids([*texts.values()])), strict=True))
    limits = vector_pack.Limits()
    rows = vector_pack.pack(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(2), WORDS, limits=limits).collect()
    used = check_packing(rows, ids, limits)
    assert sum(limits.tokens - u for u in used if u & (u - 1)) <= 0.02 * sum(used)


def test_packing_under_all_limits():
    limits = vector_pack.Limits(tokens=64, segments=5, loss=40)
    loss = lambda example, start, length: length // 2 if example % 2 else length
    packer = vector_pack.Packer(limits, 7, window=20, loss_of=loss)
    sizes = {i: 1 + (i * 37) % 150 for i in range(200)}
    for i, n in sizes.items():
        packer.add(i, n)
    packer.finish()
    done, sequences = dict.fromkeys(sizes, 0), {}
    for example, start, length, sequence, offset in sorted(packer.out, key=lambda x: (x[0], x[1])):
        assert start == done[example]
        done[example] += length
        sequences.setdefault(sequence, []).append((offset, length, loss(example, start, length)))
    assert done == sizes
    for parts in sequences.values():
        assert sum(x[1] for x in parts) <= 64 and len(parts) <= 5 and sum(x[2] for x in parts) <= 40


def test_packing_edge_rows(spark):
    rows = vector_pack.pack(spark.createDataFrame([(None, None, 1), (2, "", 1), (2, "", 1)], "doc_id long, text string, start int"), WORDS).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in rows) == [(0, 1, 1), (2, 1, 1), (2, 1, 1)]
    assert vector_pack.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_word_ids_of_letters_before_stops():
    """Letters that lower-casing or composition changes, each before a stop and a comma."""
    letters = [chr(c) for c in [*range(0x41, 0x590), 0x1E9E, 0x1F88, 0x212A, 0x2160, 0x24B6, 0x10400, 0x1E900, 0x3042, 0x0E01, 0xAC00, 0xFB01] if chr(c).strip()]
    texts = [f"{a}{x}{b}" for x in letters for a in ("", "w", "W") for b in (".", ",", "...")]
    texts += [f"e{chr(m)}." for m in range(0x300, 0x370)] + [f"e{chr(m)}s," for m in range(0x300, 0x370)]
    ids, counts = vector_pack.token_ids(pa.array(texts), WORDS)
    assert split(ids, counts) == reference_ids(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abIİıſßΣς.,'  \n<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_word_ids_of_random_texts(texts):
    ids, counts = vector_pack.token_ids(pa.array(texts, pa.string()), WORDS)
    assert split(ids, counts) == reference_ids(texts)


def test_turns_under_all_limits(spark, monkeypatch):
    words = ["alpha", "beta", "gamma,", "delta.", "Épsilon"]
    rows = [(c, t, "user" if t % 2 else "assistant", " ".join(words[(c * k + t) % 5] for k in range(1, (c * 37 + t * 53) % 200 + 1)), "x") for c in range(40) for t in range(1 + c % 5)]
    rows += [(7, 99, "assistant", "long answer " * 900, "x"), (None, None, None, None, "x"), (5, 0, "user", None, "x"), (5, 0, "user", None, "x")]
    limits = vector_pack.Limits(tokens=512, segments=6, loss=200)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start string")
    got = vector_pack.pack_turns(df.repartition(3), WORDS, limits=limits).collect()
    wanted = {}
    for c, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).extend((x, role == "assistant") for x in [*reference_ids([text or ""])[0], 2])
    examples, sequences = {}, {}
    for r in got:
        examples.setdefault((r.conv_id, r.turn), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for c, ids in wanted.items():
        at = 0
        for key in sorted((k for k in examples if k[0] == c), key=lambda k: k[1] or 0):
            begin = at
            for r in sorted(examples[key], key=lambda r: r.start):
                part = ids[at : at + r.length]
                assert r.start == at - begin and r.loss_tokens == sum(x[1] for x in part)
                assert r.ids_crc32 == zlib.crc32(np.array([x[0] for x in part], "<u4").tobytes())
                at += r.length
            assert at - begin == examples[key][0].example_tokens
        assert at == len(ids)
    loss = []
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= 512 and len(parts) <= 6
        loss.append(sum(r.loss_tokens for r in parts))
    assert 190 <= max(loss) <= 200  # the limit binds
    assert vector_pack.pack_turns(df.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        vector_pack.Limits(loss=0)
