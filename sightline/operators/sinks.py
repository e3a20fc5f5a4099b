"""What is written: crops as files, decisions and manifest as tables, the report as one CSV layout."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sightline.functions import scoring as S
from sightline.operators import decide as D
from sightline.operators import report as R
from sightline.operators.tables import settled


@dataclass
class Written(WriterCommitMessage):
    """What a task has done: files written, and the name of its list of failures, if it has any."""

    files: int
    failures: str | None


class CropWriter(DataSourceWriter):
    """Writes rows of photo_id, candidate_idx, output_name and content as files.

    A file is written under a name of its own and then moved to its place, so there are whole files or none, also
    where a task is lost, and a task that runs again puts the same files in the same places. A row that can't be written is no
    error of the job: it goes to the task's list of failures. Lists count once the job commits.
    """

    def __init__(self, options: dict):
        self.uri, self.job = options["path"], options["job"]

    def _place(self) -> tuple[fs.FileSystem, str]:
        files, base = fs.FileSystem.from_uri(self.uri)
        return files, base.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = self._place()
        own = uuid.uuid4().hex
        hidden, made, written, failed = f"{base}/_tmp-{self.job}", set(), 0, []
        files.create_dir(hidden)
        for k, row in enumerate(iterator):
            target = f"{base}/{row.output_name}"
            try:
                if row.content is None:
                    raise OSError("no content")
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                part = f"{hidden}/{own}-{k}"
                with files.open_output_stream(part) as out:
                    out.write(bytes(row.content))
                files.move(part, target)
                written += 1
            except OSError as e:
                failed.append(json.dumps({"photo_id": str(row.photo_id), "candidate_idx": row.candidate_idx, "output_name": row.output_name, "why": str(e)[:200]}))
        if not failed:
            return Written(written, None)
        with files.open_output_stream(f"{hidden}/{own}.failed") as out:
            out.write(("\n".join(failed) + "\n").encode())
        return Written(written, f"{own}.failed")

    def commit(self, messages: list[Written | None]) -> None:
        files, base = self._place()
        files.create_dir(f"{base}/_failed/{self.job}")
        for m in messages:
            if m is not None and m.failures:
                files.move(f"{base}/_tmp-{self.job}/{m.failures}", f"{base}/_failed/{self.job}/{m.failures}.json")
        self._clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        if files.get_file_info(f"{base}/_tmp-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/_tmp-{self.job}")


class CropFiles(DataSource):
    """The format ``sightline-crops``, for writing."""

    @classmethod
    def name(cls) -> str:
        return "sightline-crops"

    def writer(self, schema: T.StructType, overwrite: bool) -> CropWriter:
        return CropWriter(self.options)


def write_crops(rows: DataFrame, path: str) -> DataFrame:
    """Writes ``content`` of each row as the file ``output_name`` in a folder (a URI that Arrow opens); gives the rows that couldn't be written.

    The result has photo_id, candidate_idx, output_name and ``why``, one row for each failed write.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(CropFiles)
    rows.select("photo_id", F.col("candidate_idx").cast("int").alias("candidate_idx"), "output_name", "content").write.format("sightline-crops").mode("append").options(path=path, job=job).save()
    said = spark.read.schema("photo_id string, candidate_idx int, output_name string, why string").json(f"{path.rstrip('/')}/_failed/{job}")
    return said.withColumn("photo_id", F.col("photo_id").cast(rows.schema["photo_id"].dataType))


def with_failures(decisions: DataFrame, failed: DataFrame) -> DataFrame:
    """Decisions in which an accepted crop that couldn't be written is a reject with the reason ``write_failed``."""
    lost = failed.select("photo_id", "candidate_idx").distinct().withColumn("_lost", F.lit(True))
    out = decisions.join(lost, ["photo_id", "candidate_idx"], "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)) & (F.col("decision") == "accept"))
    changed = {"decision": F.when(F.col("_lost"), "reject").otherwise(F.col("decision")), "reason": F.when(F.col("_lost"), "write_failed").otherwise(F.col("reason"))}
    return out.withColumns(changed).drop("_lost").select(decisions.columns)


def write_manifest(decisions: DataFrame, path: str) -> None:
    """Accepted crops, in a folder per class."""
    out = decisions.filter(F.col("decision") == "accept").withColumn("quality_folder", S.folder(F.col("quality_class")))
    out.select("photo_id", "candidate_idx", "crop", "score", "sharpness", "enhance_mode", "enhancement_reason", "output_name", "quality_folder").write.mode("overwrite").partitionBy("quality_folder").parquet(path)


def write_report(decisions: DataFrame, path: str, s: dict, kept_whole: DataFrame | None = None, errors: DataFrame | None = None) -> list[str]:
    """The report as text parts that are one CSV file if they are put together by name; gives its header.

    The first line has a byte order mark and the header; rows follow in order of photo and candidate. Parts are sorted ranges of photos,
    so none of them has all rows. ``decisions`` may be a written table of ``report_columns``, which is then read as it is (once for the header, once for the rows).
    """
    told = decisions if "is_full_frame" in decisions.columns else settled(D.report_columns(decisions, s))
    rows = R.report_rows(told, kept_whole, errors)
    header = R.header(rows)
    head = rows.sparkSession.createDataFrame([("\ufeff" + ",".join(header),)], "value string")
    lines = rows.select("photo_id", "place", R.line(rows, header).alias("value"))
    whole = head.select(F.lit(None).cast(rows.schema["photo_id"].dataType).alias("photo_id"), F.lit(-1).alias("place"), "value").unionByName(lines)
    whole.repartitionByRange(F.asc_nulls_first("photo_id"), F.col("place")).sortWithinPartitions(F.asc_nulls_first("photo_id"), "place").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return header
