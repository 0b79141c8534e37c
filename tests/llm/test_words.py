import collections
import re

import numpy as np
import pyarrow as pa

from murmuration.llm.perplexity import base_counts
from murmuration.llm.text_blocks import BLOCK_BYTES, blocks, gram_hash, range_hash, shingle_hashes, string_buffers, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "\n\n", "a\nb\na\n a\na", "x y z w v x y z w v", " \n \n", "é é é é é é", "a\n", "\na\na", " a  b\x1cc", "#*$%&|<>", "a b c d e f " * 50]


def brute(t):
    t = t or ""
    words, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {i + j for i in range(len(words) - 4) if n[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(twice)


def test_words_match_the_pattern():
    w = words_of(pa.array(TEXTS, pa.string()))
    for r, t in enumerate(TEXTS):
        own = [bytes(w.raw[a:b]).decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)]
        assert own == WORD.findall(t or "")


def test_base_counts_match_brute_force():
    got = list(zip(*[x.tolist() for x in base_counts(pa.array(TEXTS, pa.string()))], strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_shingles_of_short_rows_and_rows_apart():
    row, h = shingle_hashes(words_of(pa.array(["a b", "a b", "a b c d e", "", "b a", "z a b c d e"])), 5)
    assert row.tolist() == [0, 1, 2, 4, 5, 5]
    assert h[0] == h[1] != h[3] and h[2] == h[5] and len(set(h.tolist())) == 4


def test_blocks_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "d" * 50, "", "ef"]})
    parts = list(blocks(batch, "text", 10))
    assert sum(p.num_rows for p in parts) == 5 and [p.num_rows for p in parts] == [2, 1, 2]
    assert string_buffers(pa.array([], pa.string()))[1].tolist() == [0]
    assert np.array_equal(string_buffers(pa.array([None, "é"]))[1], [0, 0, 2])


def thue_morse(a: str, b: str, n: int = 10) -> str:
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x


def test_structured_texts_do_not_collide():
    """A Thue-Morse word and its complement cancel out in any polynomial hash modulo 2^64."""
    x, y = thue_morse("a", "b"), thue_morse("b", "a")
    texts = [f"{x}\n{y}", f"{x}\n{y}\n{x}", " ".join([x, *"1234", y, *"1234", x, *"1234"]), x * 20 + "\n" + y * 20]
    got = list(zip(*[c.tolist() for c in base_counts(pa.array(texts))], strict=True))
    assert got == [brute(t) for t in texts]
    raw = np.frombuffer((x + y).encode(), np.uint8)
    assert len(set(range_hash(raw, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    _, h = shingle_hashes(words_of(pa.array([x + " a b c d", y + " a b c d"])), 5)
    assert h[0] != h[1]
    for k in (1, 5, 8, 31, 32, 40):
        g = gram_hash(raw, k)
        spelled = {bytes(raw[i : i + k]) for i in range(len(raw) - k + 1)}
        assert len(g) == len(raw) - k + 1 and len(set(g.tolist())) == len(spelled)


def test_one_text_much_longer_than_a_block():
    text = "\n".join(f"line {k % 900} of a long text, word{k}" for k in range(200_000))
    got = [int(c[0]) for c in base_counts(pa.array([text]))]
    words = WORD.findall(text)
    assert len(text) > 3 * BLOCK_BYTES and got[0] == len(words) and got[1] == sum(map(len, words)) and got[3] == 0
