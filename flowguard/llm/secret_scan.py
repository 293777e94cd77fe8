"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed. The ledger says which blob was scanned under which
rule versions and what was found; a run scans only blob and rule-version pairs that are not in it, each
blob once however many paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import new_folder, stage

#: The base patterns, the group whose length counts, and the least length.
ASSIGN = r"(?:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def finder(self):
        compiled = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        group, least = self.group, self.least
        return lambda text: [m.span() for m in compiled.finditer(text) if m.end(group) - m.start(group) >= least]


RULES = (
    Rule("assign", ASSIGN, group=2, least=12, any_case=True, base=True),
    # a maximal run is kept or dropped whole, so a least length in the pattern finds the same runs faster
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,kind:string,start:int,end:int>>"


def _scan(rules: tuple[Rule, ...]):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {r.name: (r.kind, r.finder()) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = []
                for text, names in zip(part.column("text"), part.column("rules").to_pylist(), strict=True):
                    text = text.as_py()
                    found.append(
                        [
                            {"rule": name, "kind": kind_, "start": a, "end": b}
                            for name, (kind_, find) in ((n, finders[n]) for n in names)
                            for a, b in find(text)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [part.column("blob"), part.column("rules"), pa.array(found, kind)], ["blob", "rules", "findings"]
                )

    return scan


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` (a folder, may not exist yet) has not seen, append to it, and return (findings, scanned).

    ``versions`` has path, version and text (null: empty). findings: one row per input row with path,
    version, blob (sha256) and findings of the given rules in their versions (array of kind, start, end in code points).
    scanned: the rows this run added.
    """
    spark = versions.sparkSession
    blob = F.unhex(F.sha2(F.col("text"), 256))
    given = versions.select("path", "version", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", blob)
    paths = stage(given.select("path", "version", "blob"), "secret-paths")
    entries = spark.createDataFrame([], LEDGER)
    if _exists(spark, ledger):
        entries = spark.read.schema(LEDGER).parquet(ledger)
    seen = entries.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    unseen = (
        given.groupBy("blob")
        .agg(F.first("text").alias("text"))
        .join(seen, "blob", "left")
        .withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .filter(F.size("rules") > 0)
        .select("blob", "text", "rules")
    )
    scanned = stage(unseen.mapInArrow(_scan(rules), LEDGER), "secret-scan")
    scanned.write.mode("append").parquet(ledger)
    known = [r.name for r in rules]
    # ledgers written before findings had their rule: it is the one of that kind in the row
    named = F.transform(
        "findings",
        lambda f: f.withField("rule", F.coalesce(f["rule"], F.get(F.filter("rules", lambda r: F.regexp_replace(r, "@[0-9]+$", "") == f["kind"]), F.lit(0)))),
    )
    found = (
        spark.read.schema(LEDGER)
        .parquet(ledger)
        .filter(F.size("findings") > 0)
        .groupBy("blob")
        .agg(F.flatten(F.collect_list(named)).alias("findings"))
    )
    of_known = F.filter("findings", lambda f: f["rule"].isin(known))
    current = F.transform(of_known, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    joined = paths.join(stage(found, "secret-found"), "blob", "left")
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select("path", "version", "blob", F.coalesce(current, nothing).alias("findings")), scanned


def _exists(spark, folder: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def document_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (empty and null texts: no spans)."""
    versions = docs.select(F.col("doc_id").cast("long").alias("path"), F.lit(1).alias("version"), F.col("text").cast("string").alias("text"))
    found, _ = scan_versions(versions, new_folder(docs.sparkSession, "secret-ledger"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    ordered = F.array_sort(
        F.transform("findings", lambda f: F.struct(f["start"], F.array_position(kinds, f["kind"]).alias("no"), f["end"], f["kind"]))
    )
    label = lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])
    base = [r.kind for r in RULES if r.base]
    listed = found.withColumn("findings", ordered)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("findings", lambda f: f["kind"].isin(base))
    return listed.select(
        F.col("path").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(F.concat_ws(",", F.transform(own, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("findings", label)).alias("spans"),
    )
