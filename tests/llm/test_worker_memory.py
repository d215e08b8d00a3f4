"""A worker gives back memory after a task's last batch."""

import re
from pathlib import Path

import pytest

from namelens.llm import common


def _anonymous_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_memory_goes_back():
    def held(batches):
        for n in batches:
            parts = [bytes(1000) for _ in range(n)]
            last = parts[-1], bytes(1000)  # stays above what is freed
            del parts
            yield last

    before = _anonymous_mb()
    run = common.trimmed(held)(iter([200_000]))
    kept = [next(run)]
    full = _anonymous_mb() - before
    assert list(run) == [] and len(kept) == 1
    assert full > 150 and _anonymous_mb() - before < full / 2
