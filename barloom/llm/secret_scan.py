"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text, so copies and unchanged versions are one
blob. The ledger holds one row per (blob, rule version) ever scanned, with its findings. A run scans only the
pairs the ledger lacks and joins findings back to all paths of a blob.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import fold, map_arrow
from barloom.session import cut_lineage

#: kind, pattern, group whose length counts (0: the match), fewest characters; fixed values, in rank order.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
RULE_VERSION = "base-1"
#: One in so many paths belongs to the first of two runs.
FIRST_OF = 8
LEDGER = "blob string, rules string, spans array<struct<kind:string,start:int,end:int>>"
# Long enough runs only: a run of hex digits is maximal either way, so the spans are the same.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of the rules."""
    found, text = [], text or ""
    for rank, (kind, pattern, group, fewest) in enumerate(RULES):
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m.group(group)) >= fewest:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches):
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in batch.column("text").to_pylist()]
        yield batch.column("blob"), found


def versions_of(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, blob): a null text counts as empty."""
    return documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))


def extend_ledger(documents: DataFrame, ledger: DataFrame | None = None, rules: str = RULE_VERSION) -> DataFrame:
    """``ledger`` and, for each blob of ``documents`` it lacks under ``rules``, one new row; written to the shared folder.

    Copies are collapsed in the map tasks before the shuffle, so a text with a third of all rows crosses it
    once per task. A ledger of None is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    blobs = documents.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        # not a left_anti join, which would be moved below the collapsing of copies
        known = ledger.filter(F.col("rules") == rules).select("blob", F.lit(True).alias("known"))
        blobs = blobs.join(known, "blob", "left").filter("known is null").select("blob", "text")
    scanned = map_arrow(blobs, _scan, "blob string, spans array<struct<kind:string,start:int,end:int>>")
    new = scanned.select("blob", F.lit(rules).alias("rules"), "spans")
    return cut_lineage(new if ledger is None else ledger.unionByName(new))


def scan_documents(documents: DataFrame, ledger: DataFrame | None = None, rules: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has one row (doc_id, blob, spans) per row of ``documents``.

    Null and empty texts share the empty blob and have no spans. Repeated rows and equal texts give equal
    findings; a null doc_id is kept; other columns are ignored; an empty table gives empty results.
    """
    ledger = extend_ledger(documents, ledger, rules)
    hits = ledger.filter((F.col("rules") == rules) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.array().cast(T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>"))
    return versions_of(documents).join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), ledger


def scan_history(documents: DataFrame, parts: int = FIRST_OF, rules: str = RULE_VERSION) -> DataFrame:
    """The findings of a run over all ``documents`` that starts from the ledger of a run over some of them.

    The first run takes about one in ``parts`` of the paths (doc_id), the second takes all and scans the blobs that the
    first has not seen. Rows and odd cases are those of ``scan_documents``; a null doc_id waits for the second run.
    """
    before = extend_ledger(documents.filter(fold(F.col("doc_id"), parts) == 0), rules=rules)
    return scan_documents(documents, before, rules)[0]


def digest(findings: DataFrame) -> DataFrame:
    """Counts per kind, the spans as text and their hash. The ledger adds no spans of its own to the base ones."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return findings.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"),
    )
