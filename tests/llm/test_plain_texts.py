"""Which texts are cut here and which go to the tokenizer library, and at what cost."""

import random
import re
import time

import public_tokenizers

from blockfield.llm import counting

SLOW = re.compile("(?:[\t\n\r\x0b\x0c\x20-;=-~À-ÖØ-öø-ÿ]|<(?!\\|))*")
FAST = re.compile(counting.PLAIN)


def test_plain_texts_are_told_by_runs():
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab <|>é×\ǹ'1", weights=[9, 9, 5, 3, 1, 2, 2, 0.2, 1, 0.2, 1, 1], k=rng.randint(0, 30))) for _ in range(5000)]
    verdicts = [bool(SLOW.fullmatch(t)) for t in texts]
    assert verdicts == [bool(FAST.fullmatch(t)) for t in texts] and 500 < sum(verdicts) < 4500

    def least(pattern):
        text, best = "some words in a row, <b>and</b> more of them\n" * 2000, 1e9
        for _ in range(5):
            start = time.perf_counter()
            assert pattern.fullmatch(text)
            best = min(best, time.perf_counter() - start)
        return best

    assert least(FAST) < 0.7 * least(SLOW)


def test_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = counting.tokenizer(path)
    for text in ("", "It's <b>we'll</b> 12 é ÀÖ", "<|endoftext|> a", "a<", "<<|", "tab\tand\nline  two"):
        assert counting.encode(text, path) == library.encode(text, add_special_tokens=False).ids
