import random
import tempfile

import numpy as np
import pytest

from gneiss.llm.induced import DiskQueue, Sorter


@pytest.mark.parametrize("memory", [3, 40, 1 << 20])
def test_queue(tmp_path, memory):
    rnd = random.Random(1)
    queue, held = DiskQueue(str(tmp_path), memory, 2), []
    for _ in range(3000):
        if rnd.random() < 0.6 or not held:
            item = (rnd.randrange(1000), rnd.randrange(1000))
            queue.push(item)
            held.append(item)
        else:
            held.sort()
            assert queue.peek() == held[0] and queue.pop() == held.pop(0)
    assert [queue.pop() for _ in range(len(held))] == sorted(held)


@pytest.mark.parametrize("memory", [8, 1 << 20])
def test_suffixes_and_prefixes(memory):
    rnd = random.Random(2)
    for trial in range(120):
        size = rnd.choice([1, 2, 3, 10, 60, 200])
        letters = rnd.choice([1, 2, 3, 30])
        text = [rnd.randrange(1, letters + 1) for _ in range(size - 1)] + [0]
        if trial % 3 == 0 and size > 20:
            text[: size // 2] = text[size // 2 - 1 : -1][: size // 2] if size % 2 == 0 else text[: size // 2]
        with tempfile.TemporaryDirectory() as folder:
            got = list(Sorter(folder, memory).suffixes(text, len(text)))
        want = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        assert [i for i, _ in got] == want, text
        for (a, _), (b, common) in zip(got, got[1:]):
            n = 0
            while text[a + n] == text[b + n]:
                n += 1
            assert common == n, (text, a, b)


def test_default_shards_are_larger_than_memory(tmp_path):
    """A shard of the main path goes to disk: blocks of about 16 symbols, 40,000 a shard, 1 << 18 in memory."""
    import inspect

    from gneiss.llm import passages

    size = {k: v.default for k, v in inspect.signature(passages._sorted_repeats).parameters.items()}
    assert 2 * size["memory"] < 16 * size["blocks_per_shard"]
    rnd = random.Random(3)
    base = [rnd.randrange(1, 200) for _ in range(300)]
    text = [x for _ in range(20) for x in (*base[: rnd.randrange(100, 300)], rnd.randrange(1, 200))] + [0]
    sorter, small = Sorter(str(tmp_path), len(text) // 4), Sorter(str(tmp_path), len(text))
    assert list(sorter.suffixes(text, len(text))) == list(small.suffixes(text, len(text)))
    assert sorter.spilled > 0 and small.spilled == 0


def test_runs_are_merged(tmp_path, monkeypatch):
    from gneiss.llm import induced

    monkeypatch.setattr(induced, "RUNS", 4)
    rnd = random.Random(9)
    plain, buckets = DiskQueue(str(tmp_path), 5, 2), induced.BucketQueue(str(tmp_path), 5)
    items = [(rnd.randrange(20), n) for n in range(400)]
    for s, n in items:
        plain.push((s, n))
        buckets.push(s, n, -n)
    assert len(plain.runs) < 4 and len(buckets.runs) < 4
    assert [plain.pop() for _ in items] == sorted(items)
    assert [buckets.pop()[0] for _ in items] == [n for _, n in sorted(items)]  # first in first out within a symbol


def test_memory_does_not_grow_with_the_symbols(tmp_path, monkeypatch):
    """Four times the blocks, each with a mark and a core of its own, at the same memory and as many open runs."""
    import tracemalloc

    from gneiss.llm import induced

    monkeypatch.setattr(induced, "RUNS", 8)

    def peak(blocks):
        rnd = random.Random(blocks)
        text = [x for k in range(blocks) for x in (-2 - k, *(rnd.randrange(256) for _ in range(5)), 256 + k // 2, *(rnd.randrange(256) for _ in range(5)))] + [-2 - blocks]
        np.array(text, np.int64).tofile(tmp_path / "text")
        size = len(text)
        del text
        tracemalloc.start()
        count = sum(1 for _ in Sorter(str(tmp_path), 500).suffixes_of_file(str(tmp_path / "text"), size))
        high = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == size
        return high

    small, large = peak(1500), peak(6000)
    assert large < 1.5 * small
