"""Winnowing of texts so short that a long gram or window sees nothing of them."""

import random

from prefscan.llm import winnowing


def test_short_texts_are_like_their_edited_half():
    rng = random.Random(2)
    win = winnowing.Winnower()

    def text(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    for n in [*range(30, 143), 200, 400]:
        for _ in range(5):
            a, b = winnowing._Row(win, text(n)), winnowing._Row(win, text(n))
            assert a.against(win, b)[4] > 0, n
