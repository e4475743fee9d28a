import random
import tempfile

import numpy as np

from larkspur.llm.induced import CAP, sort_suffixes


def run(s: bytes, hold: int):
    n = len(s) + 1
    t = np.zeros(n + CAP + 40, np.uint16)
    t[: len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    out = []
    with tempfile.TemporaryDirectory() as d:
        sort_suffixes(t, n, 257, d, lambda p, lcp: out.append((p, lcp)), hold)
    return np.concatenate([p for p, _ in out[::-1]]).tolist(), np.concatenate([x for _, x in out[::-1]]).tolist()


def test_order_and_common_prefixes():
    r = random.Random(3)
    for k in range(150):
        s = bytes(r.choice(b"ab" if k % 3 else b"abcdefg") for _ in range(r.randint(0, 120)))
        if k % 5 == 0:
            s = s[:20] * r.randint(1, 6) + s
        order, lcp = run(s, 5 if k % 2 else 1 << 20)  # 5: all but a few tuples wait on disk
        want = sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert order == want
        for i in range(1, len(want)):
            x, y, c = s[want[i - 1] :], s[want[i] :], 0
            while c < min(len(x), len(y)) and x[c] == y[c]:
                c += 1
            assert lcp[i] == min(c, CAP)


def test_long_repeats_are_equal_up_to_the_cap():
    s = b"ab" * 1000 + b"c" + b"ab" * 1000
    order, lcp = run(s, 100)
    assert sorted(order) == list(range(len(s) + 1))
    for i in range(1, len(order)):
        a, b = s[order[i - 1] :][:CAP], s[order[i] :][:CAP]
        assert a <= b and (lcp[i] < CAP or a == b)
