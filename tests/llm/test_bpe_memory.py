"""How many Python steps follow each other in op5, what its workers keep, and that its digests are the library's."""

import hashlib
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, queries

#: Anonymous memory, in MB, that a vocabulary adds to a process that has the modules already.
KEPT = """
import re, pyspark.worker, pandas, numpy, pyarrow
from quarry.llm import bpe
import public_tokenizers
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
source = bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))
before = held()
kept = bpe.vocabulary(source)
print(held() - before)
"""


def test_one_worker_decodes_and_digests(spark, tmp_path):
    texts = {1: "plain words, twice: plain words", 2: "", 3: None, 4: "žluťoučký kůň 日本語 ​<|endoftext|>!"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_bpe(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # two splits, and one step behind the ids
    library = Tokenizer.from_str(bpe.read_text(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    wanted = []
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, found.collect())) == wanted


def test_null_ids_have_the_digests_of_nothing(spark):
    source = bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.digest(bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), source, hashed=True)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, rows)) == [(1, 0, nothing, nothing), (2, 0, nothing, nothing)]


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_vocabulary_keeps_no_parsed_file():
    said = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, timeout=120, check=True)
    assert float(said.stdout) < 32
