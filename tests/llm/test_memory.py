"""What a Python worker takes for a large batch and keeps after the task, measured in a process of its own."""

import json
import subprocess
import sys
from pathlib import Path

TASK = """
import ctypes, json, re, threading, time
import numpy as np, pyarrow as pa
from inkstone.llm import common, subword_quality, token_rans
from inkstone.llm.queries import tokenizer_path

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def watch():
    while True:
        peak[0] = max(peak[0], held())
        time.sleep(0.005)

rng = np.random.default_rng(1)
letters = rng.integers(97, 123, (200_000, 7), np.uint8).tobytes().decode()
words = [letters[k : k + 7] for k in range(0, len(letters), 7)]
texts = [" ".join(words[k] for k in rng.integers(0, len(words), 330)) for _ in range(8_000)]  # 21 MB
batch = pa.RecordBatch.from_arrays([pa.array(range(8_000)), pa.array(range(8_000)), pa.array(texts)], names=["doc_id", "tie", "text"])
del texts, words, letters
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
lean = getattr(common, "lean", lambda job: job)
margin = {"margin": np.zeros(1 << subword_quality.BUCKET_BITS, np.float32), "bias": 0.1}
jobs = {"tokens": lean(token_rans.tokenizer_job(tokenizer_path())), "scores": lean(subword_quality.scorer(margin))}
peak, out = [0], {}
threading.Thread(target=watch, daemon=True).start()
for name, job in jobs.items():
    before, peak[0] = held(), 0
    rows = sum(x.num_rows for x in job(iter([batch])))
    out[name] = [rows, peak[0] - before, held() - before]
print(json.dumps(out))
"""


def test_workers_take_little_and_give_it_back():
    done = subprocess.run([sys.executable, "-c", TASK], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    found = json.loads(done.stdout)
    print(found)
    rows, taken, kept = found["tokens"]
    assert rows == 8_001 and taken < 180 and kept < 60
    rows, taken, kept = found["scores"]
    assert rows == 8_000 and taken < 60 and kept < 20
