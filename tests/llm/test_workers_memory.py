"""Workers give freed memory back when a task's texts end, as they are used again by other stages."""

import subprocess
import sys

import pytest

#: MB held before and after a task's texts, by a process whose heap has 128 MB of freed blocks below one that is in use.
KEPT = """
import ctypes, re
import pyarrow as pa
from quarry.llm.common import text_slices
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
libc = ctypes.CDLL(None)
libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
blocks = [libc.malloc(65536) for _ in range(2048)]
for x in blocks:
    ctypes.memset(x, 1, 65536)
for x in blocks[:-1]:
    libc.free(x)
before = held()
texts = [x for x, _ in text_slices(iter([pa.record_batch({"text": ["one", None]})]))]
assert texts == [["one", ""]]
print(before - held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_goes_back_at_the_end_of_a_task():
    said = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, timeout=120, check=True)
    assert float(said.stdout) > 100
