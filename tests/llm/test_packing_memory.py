"""Memory of a Python worker that tokenises and packs: what it has freed goes back to the system, and a batch isn't taken out whole."""

import re
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from plumbline.llm import packing

HEAD = """
import random, re, sys
import numpy as np, pyarrow as pa
from plumbline.llm import packing

class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)

packing.TaskContext = Task

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def unused():
    now = held()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    return now - held()
"""

TOKENISE = """
rng = random.Random(5)
texts = [" ".join("".join(rng.choice("enarstioulch-_1'") for _ in range(rng.randint(3, 12))) for _ in range(400)) for _ in range(2000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(map(str, range(2000))), pa.array(texts)], names=["_p_row", "doc_id", "text"])
del texts
rows = 0
for out in packing._tokeniser(None, 4096, 2, False)(iter([batch])):
    rows += out.num_rows
    if rows == 2000:
        print("unused", unused())
"""

PACK = """
import tracemalloc
rng = np.random.default_rng(5)
n = 4000
ids = [rng.integers(0, 49000, 2000).astype("<u4").tobytes() for _ in range(n)]
batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(n))), pa.array([0] * n, pa.int64()), pa.array([2000] * n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"])
del ids
pack = packing._packer((np.full(49000, 100), n, 2000.0), 4096, 1_000_000, False)
tracemalloc.start()
tokens = 0
for out in pack(iter([batch])):
    tokens += sum(out.column("length").to_pylist())
print("unused", unused())
print("taken", tracemalloc.get_traced_memory()[1] / 1e6)
print("tokens", tokens)
"""


def run(code: str) -> dict[str, float]:
    out = subprocess.run([sys.executable, "-c", HEAD + code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=300).stdout
    return {k: float(v) for k, v in re.findall(r"^(\w+) ([-\d.e]+)$", out, re.M)}


def test_a_tokenising_worker_keeps_little_unused_memory():
    assert run(TOKENISE)["unused"] < 13


def test_a_packing_worker_takes_a_shard_of_a_batch_at_a_time():
    """The batch has 32 MB of ids, a shard 1 MB."""
    said = run(PACK)
    assert said["tokens"] == 4000 * 2000
    assert said["unused"] < 10 and said["taken"] < 40, said


def test_shards_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(7)
    ids = [rng.integers(0, 300, rng.integers(1, 90)).astype("<u4").tobytes() for _ in range(200)]
    rest = pa.table({"doc_id": pa.array([None, *map(str, range(199))]), "start": pa.array([0] * 200, pa.int64()), "doc_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})
    known = (np.full(300, 9), 200, 45.0)

    def rows(shard_bytes: int, sizes: list[int]) -> list[dict]:
        at, batches = 0, []
        for n in sizes:
            batches += [pa.RecordBatch.from_arrays([c.combine_chunks() for c in rest.slice(at, n).columns], names=rest.column_names)]
            at += n
        return [r for out in packing._packer(known, 256, shard_bytes, True)(iter(batches)) for r in out.to_pylist()]

    for shard_bytes in (50, 2000, 10**6):
        want = rows(shard_bytes, [200])
        assert rows(shard_bytes, [1] * 200) == rows(shard_bytes, [0, 7, 90, 0, 103, 0]) == want
        pieces = {}
        for r in want:
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == dict(zip(rest["doc_id"].to_pylist(), ids, strict=True))
