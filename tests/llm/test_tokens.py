import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import tokens

SP, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "the", "'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "Ü", "123", "²", "½", "!", "###", " ", "\u0085", "don't", "I'VE", "…", "日本", "😀", "<|endoftext|>", "</s>", "▁", "\x00", "\x1c", "x" * 40, "ǅ", "ɐ", "ʰ"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["", " ", "\n", "'s", " 's", "a'", "a's"] + ["".join(r.choices(ALPHABET[: r.choice((12, 24, len(ALPHABET)))], k=r.randint(1, 30))) for _ in range(n)]


def test_sentencepiece_counts_are_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = random_texts(4000, 1)
    got = tokens.sentencepiece_counts([t.encode() for t in texts], SP)
    assert got.tolist() == [len(sp.encode(t)) for t in texts]


def test_byte_ids_are_the_librarys():
    t = Tokenizer.from_file(BPE)
    texts = random_texts(4000, 2)
    for a, b, text in zip(tokens.byte_bpe_ids([x.encode() for x in texts], BPE), t.encode_batch(texts, add_special_tokens=False), texts):
        assert a.tolist() == b.ids, repr(text)


def test_memo_starts_anew_when_full():
    from millrace.llm.vectext import Memo

    memo = Memo(bits=4, pool=10, most=3)
    segments = [b"%d" % i * (1 + i % 4 * 7) for i in range(1, 40)] * 2
    raw, end = b"".join(segments), np.cumsum([len(x) for x in segments])
    start = end - np.array([len(x) for x in segments])
    for _ in range(3):
        size, ids = memo.ids(raw, start, end, lambda asked: [[x[0]] * (len(x) % 3) for x in asked])
        assert size.tolist() == [len(x) % 3 for x in segments]
        assert ids.tolist() == [x[0] for x in segments for _ in range(len(x) % 3)]
        assert memo.sizes(raw, start, end, lambda asked: [len(x) % 3 for x in asked]).tolist() == size.tolist()
        memo = Memo(bits=4, pool=10, most=3)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
@pytest.mark.parametrize("letters", ["ab", "ba", "xq", "tz"])
def test_words_that_share_polynomial_hashes_keep_their_own_tokens(n, letters):
    """The sequence and its complement have one value under every polynomial modulo 2**64."""
    texts = [thue_morse(n, letters), thue_morse(n, letters[::-1]), "so " + thue_morse(n, letters), "so " + thue_morse(n, letters[::-1])]
    bodies = [x.encode() for x in texts]
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=SP), Tokenizer.from_file(BPE)
    assert tokens.sentencepiece_counts(bodies, SP).tolist() == [len(sp.encode(x)) for x in texts]
    assert [x.tolist() for x in tokens.byte_bpe_ids(bodies, BPE)] == [bpe.encode(x, add_special_tokens=False).ids for x in texts]
