import random
import time
import tracemalloc

import pytest

from loomfold.functions.tokens import BLANK, align


def table(a, b):
    """The alignment from the whole table of costs."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append((a[i], BLANK))
        else:
            j -= 1
            out.append((BLANK, b[j]))
    return out[::-1]


@pytest.mark.parametrize("few", [1, 3, 64])
def test_ties_go_as_in_the_whole_table(few):
    rng = random.Random(few)
    for _ in range(250):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 40))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        one, two = align(a, b, few=few, parts=rng.randint(2, 5))
        assert list(zip(one, two, strict=True)) == table(a, b)


def test_long_sequences_need_little_memory():
    rng = random.Random(1)
    a = [rng.randrange(500) for _ in range(6000)]
    b = [x for x in a if rng.random() < 0.9] + [7] * 300
    tracemalloc.start()
    began = time.time()
    one, two = align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for x in one if x != BLANK] == a and [x for x in two if x != BLANK] == b
    assert most < 40 << 20 and time.time() - began < 90
