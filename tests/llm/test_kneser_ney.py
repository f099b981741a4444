"""The character models against Kneser-Ney smoothing over dictionaries of tuples."""

import math
from collections import defaultdict

import pyarrow as pa
import pytest

from leadspark.llm import language as L

TEXTS = ["the cat sat on the mat", "a cat and a hat; THE rat", "then the man ran", "x", "that hat"]


def symbols(text):
    out = " " + "".join(c.lower() if c.isalpha() else " " for c in text)
    while "  " in out:
        out = out.replace("  ", " ")
    return out


class Brute:
    """Interpolated Kneser-Ney with one discount; a text's leading space is context only."""

    def __init__(self, texts):
        self.count = [None] + [defaultdict(int) for _ in range(L.ORDER)]
        rows = [symbols(t) for t in texts]
        grams = lambda n: [r[i - n + 1 : i + 1] for r in rows for i in range(max(n - 1, 1), len(r))]
        for g in grams(L.ORDER):
            self.count[L.ORDER][g] += 1
        for n in range(1, L.ORDER):
            for g in set(grams(n + 1)):
                self.count[n][g[1:]] += 1

    def p(self, context, c, n):
        if n == 0:
            return 1 / (len(self.count[1]) + 100)
        context = context[-(n - 1) :] if n > 1 else ""
        own = {g: k for g, k in self.count[n].items() if g[:-1] == context and len(g) == n}
        if not own:
            return self.p(context, c, n - 1)
        total = sum(own.values())
        k = own.get(context + c, 0)
        return max(k - L.DISCOUNT, 0) / total + L.DISCOUNT * len(own) / total * self.p(context, c, n - 1)

    def entropy(self, text):
        s = symbols(text)
        return -sum(math.log(self.p(s[max(0, i - L.ORDER + 1) : i], s[i], min(L.ORDER, i + 1))) for i in range(1, len(s))) / max(1, len(s) - 1)


@pytest.mark.parametrize("text", ["the cat", "a man sat", "that zebra", "mat", "unheard words, altogether", "q"])
def test_cross_entropy(text):
    model = L.Identifier({"one": TEXTS, "other": ["der hund und die katze", "und das ist der mann"]})
    h, n = model.entropies(pa.array([text, "", None]))
    assert h[0, 0] == pytest.approx(Brute(TEXTS).entropy(text), rel=1e-9) and n[0] == len(symbols(text)) - 1 and n[1] == n[2] == 0
