"""Change tracking: snapshot diff, manifest, change log, archive (JOIN-1, SNK-5..7, WIN-7, AGG-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx

LOGGED = ("initial", "changed", "restored")


def fingerprint(snapshots: DataFrame, id_col: str, content_col: str, *keep: str) -> DataFrame:
    """(id, content_hash, bytes, …): the diff never carries page contents."""
    content = F.col(content_col)
    return snapshots.select(F.col(id_col).alias("id"), *keep,
                            F.sha2(content, 256).alias("content_hash"),
                            F.octet_length(content).cast("long").alias("bytes"))


def diff_snapshots(incoming: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """JOIN-1: (id, status, old_hash, new_hash) from (id, content_hash) on both sides.

    initial: unknown id.  changed: known id, stored file present, other hash.  restored: known
    id whose stored file is gone.  unchanged: same hash and file present; with ``force`` these
    become rewritten.  removed: known id that was not delivered.  ``manifest`` may say with a
    boolean ``raw_present`` whether the stored file still exists; without it, it does.
    """
    present = F.col("raw_present") if "raw_present" in manifest.columns else F.lit(True)
    old = manifest.select("id", F.col("content_hash").alias("old_hash"), present.alias("_present"),
                          F.lit(True).alias("_known"))
    new = incoming.select("id", F.col("content_hash").alias("new_hash"), F.lit(True).alias("_delivered"))
    same = F.col("old_hash").eqNullSafe(F.col("new_hash"))
    status = (F.when(F.col("_delivered").isNull(), "removed")
              .when(F.col("_known").isNull(), "initial")
              .when(~F.coalesce("_present", F.lit(True)), "restored")
              .when(~same, "changed")
              .otherwise("rewritten" if force else "unchanged"))
    return new.join(old, "id", "full_outer").select("id", status.alias("status"), "old_hash", "new_hash")


def to_write(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("initial", "changed", "restored", "rewritten"))


def run_counts(diff: DataFrame) -> DataFrame:
    """AGG-3: one row with the number of documents per outcome."""
    names = ("initial", "changed", "restored", "rewritten", "unchanged", "removed")
    updated = F.col("status").isin("initial", "changed", "restored") & ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    return diff.agg(F.count_if(updated).alias("updated"),
                    *[F.count_if(F.col("status") == n).alias(n) for n in names])


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """WIN-7: the newest row per key; a hash aggregate, so a key with many versions is
    reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_r")
    return rows.groupBy(key).agg(newest).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_manifest(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """SNK-5: latest state per id from the stored manifest and newly written rows."""
    return latest(manifest.unionByName(written, allowMissingColumns=True), "id", "fetched_at", "content_hash")


def change_log(diff: DataFrame, as_of: Column) -> DataFrame:
    """SNK-6: log records (as_of, id, status, old_hash, new_hash)."""
    return (diff.where(F.col("status").isin(*LOGGED))
            .select(as_of.alias("as_of"), "id", "status", "old_hash", "new_hash"))


def archive_rows(stored: DataFrame, diff: DataFrame, as_of: Column) -> DataFrame:
    """SNK-7: stored versions about to be replaced, stamped; join on id with the changed ones only."""
    changed = diff.where(F.col("status") == "changed").select("id")
    return stored.join(changed, "id", "left_semi").withColumn("stamp", tx.snapshot_stamp(as_of))


def attach_targets(snapshots: DataFrame, targets: DataFrame) -> DataFrame:
    """JOIN-2: law name, title and url by document id.  No hint: targets may be one row per
    document, so the side to broadcast is left to the measured sizes."""
    return snapshots.join(targets, "id")


def select_ids(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """SRC-2/JOIN-4: rows whose key is wanted."""
    return df.join(wanted.select(key), key, "left_semi")


def missing_ids(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """SRC-2/JOIN-4/SET-2: wanted keys that do not exist, each once."""
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")
