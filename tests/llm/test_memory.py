"""What a task leaves behind in its worker."""

import pathlib
import re

from lectern.llm.common import release


def _resident() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", pathlib.Path("/proc/self/status").read_text())[1]) >> 10


def test_freed_memory_goes_back():
    """Also what lies between values that stay."""
    held = [bytes([k % 251]) * 100_000 for k in range(2000)]
    peak = _resident()
    held = held[::50]
    release()
    assert _resident() < peak - 120 and len(held) == 40
