import random
import re

import xxhash

from lagloom.llm import templates as T


class Counted:
    def __init__(self, pattern):
        self.pattern, self.n = pattern, 0

    def search(self, text):
        self.n += 1
        return self.pattern.search(text)


def meaning(chunk):
    """(code, code after a number, code as it stands, flags) by the patterns alone."""
    core = re.search(r"\w(?:.*\w)?%?", chunk, re.S)
    word = core[0] if core else chunk
    low = word.lower()
    plain = xxhash.xxh64_intdigest(low.encode("utf-8", "replace"))
    spelt = low in T.NUMBER_WORDS
    number = spelt or bool(T.NUMBER.fullmatch(word))
    own = T._NUM if number else T._NAME if T.is_name(word) else plain
    counted = own == plain and (low in T.UNITS or len(low) > 2 and low.isalpha() and low not in T.NOT_COUNTED)
    ends = chunk.rstrip("\"')»”").endswith((".", "!", "?", ":"))
    return own, T._UNIT if counted else own, plain, number * T.IS_NUMBER | ends * T.ENDS | spelt * T.IS_WORD_NUMBER | chunk.endswith(word) * T.OPEN


def test_words_of_letters_need_no_patterns(monkeypatch):
    rng = random.Random(4)
    plain = ["Anna", "Anna.", "km", "five,", "Twenty", "and", "ǅa", "ß", "ΣΑΣ!", "日本", "İstanbul:", "McKay", "a", "A", "É;"]
    odd = ["...", "-", "O’Neill", "Smith-jones,", "twenty-one", "12.5%", "$3,000.", "(Anna)", '"Anna."', "a,b", "a,,", "x\ud800", "_a_", "é", "%"]
    plain += ["".join(rng.choices("abcdeAÉß日ж", k=rng.randint(1, 6))) + rng.choice(["", "", *".,;:!?"]) for _ in range(300)]
    odd += ["".join(rng.choices("aB1.,-'’%\"ß", k=rng.randint(2, 6))) + "-" for _ in range(300)]
    reader, seen = T.Reader(), Counted(T.CORE)
    monkeypatch.setattr(T, "CORE", seen)
    reader.read([" ".join(plain), " ".join(plain)])
    assert seen.n == 0
    reader.read([" ".join(odd)])
    got = {c: (*(codes[at] for codes in reader.codes), reader.flags[at]) for c, at in reader.at.items()}
    assert got == {c: meaning(c) for c in [*plain, *odd]}
