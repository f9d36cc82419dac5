"""Secret scans on the given documents with keys and identifiers of real shapes planted, none of them in the training samples."""

import os
import random

import pytest

from quern.llm import secrets_scan
from tests.oracle import SF_DIR

DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.01")
UP, LOW, DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def keys(r):
    rand = lambda n, a=UP + LOW + DIG: "".join(r.choice(a) for _ in range(n))
    made = [rand(40, UP + LOW + DIG + "+/"), "ghp_" + rand(36), "sk_live_" + rand(24), "AIza" + rand(35, UP + LOW + DIG + "-_"), "xoxb-" + rand(12, DIG) + "-" + rand(24), "npm_" + rand(36), "hf_" + rand(34), rand(20), rand(16), "eyJhbGciOiJIUzI1NiJ9" + rand(30), "glpat-" + rand(20, UP + LOW + DIG + "-_")]
    return made + ["xK9vQ2mZp7LwR4tYbN8c", "wJalrXUtnFEMIbPxRfiCYEXAMPLE"]


def identifiers(r):
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    date = f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    return [
        f"quarterly-earnings-{date}", f"getUserById{r.randrange(9)}", f"IMG_{date.replace('-', '')}_{r.randrange(100000, 999999)}", f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-a{hexes(3)}-{hexes(12)}", f"usr/local/lib/python{r.randrange(3, 9)}/site-packages",
        "MAX_RETRY_ATTEMPTS", "handleMouseClickEvent", f"backup_{date}_full", f"978-3-16-{r.randrange(100000, 999999)}-{r.randrange(9)}a", "state-of-the-art-technology", "HttpServletRequestWrapper", f"release-candidate-{r.randrange(20)}", f"{date}T10_15_30Z", f"node_modules/react-dom{r.randrange(20)}", "img_20240115_123456",
    ]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_real_shapes(spark):
    r = random.Random(21)
    own = [(k, True) for _ in range(4) for k in keys(r)] + [(k, False) for _ in range(4) for k in identifiers(r)]
    rows = [(1_000_000 + i, f"the value {k} of this one") for i, (k, _) in enumerate(own)]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    out = secrets_scan.find_secrets(docs).filter("size(added) > 0").collect()
    hit = {x.doc_id - 1_000_000 for x in out if x.doc_id >= 1_000_000}
    elsewhere = sum(x.doc_id < 1_000_000 for x in out)
    right = sum(own[i][1] for i in hit)
    print(f"precision {right / len(hit):.3f}, recall {right / sum(x for _, x in own):.3f}, on given documents {elsewhere}", sorted({own[i][0] for i in hit if not own[i][1]}), sorted({k for i, (k, x) in enumerate(own) if x and i not in hit}))
    assert right / len(hit) >= 0.9 and right / sum(x for _, x in own) >= 0.9 and elsewhere <= 5
