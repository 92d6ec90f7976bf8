"""One file for each brief, named by its title.

Names: the slug of the title; of conversations with one slug the first keeps it, by conv_key, and the
k-th gets ``_k``, which no slug can end in.  Ranks come from a range exchange on (slug, conv_key):
places within a partition, plus what the partitions before hold of the same slug.  So a title
that a third of all chats have is spread over tasks like any other.

Files: a data source writer in two steps.  Every task attempt writes below a folder of its own in a
staging folder beside the target; its commit message names that folder.  Only when all tasks
have ended are the folders of the attempts that count put together and moved to the target, so a
reader sees all files or none, and what a lost or repeated attempt left goes with the staging folder.
A file belongs to the subfolder of its task: the driver moves folders, never single files.

Defined cases: a null title and one without letters or digits have the default slug; a brief in
several parts is one file; a null part is empty; a brief without title row is not written
(there is nothing to name it by); no briefs give an empty folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from briefspark.functions import text as T
from briefspark.operators.ordered import hold

FORMAT = "brief_files"
EXTENSIONS = ("md", "txt")


def file_names(meta: DataFrame) -> DataFrame:
    """meta(conv_key, title, ..) -> (conv_key, name), one name for each conversation, all different."""
    slugs = meta.select("conv_key", T.slug(F.col("title")).alias("slug")).groupBy("conv_key").agg(F.min("slug").alias("slug"))
    ranged = slugs.repartitionByRange("slug", "conv_key").withColumn("part", F.spark_partition_id())
    ranged = hold(ranged)  # the borders of the ranges are chosen once
    within = F.row_number().over(Window.partitionBy("part", "slug").orderBy("conv_key"))
    counts = ranged.groupBy("slug", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("slug").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a slug has a row here for each partition that holds some of it
    counts = counts.select("slug", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = ranged.withColumn("within", within).join(counts, ["part", "slug"])
    rank = F.col("before") + F.col("within")
    name = F.when(rank == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", rank.cast("string")))
    return ranked.select("conv_key", name.alias("name"))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class BriefFilesWriter(DataSourceWriter):
    """Rows (name, part, content), all of a name together and in order -> files."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.system, self.path = fs.FileSystem.from_uri(options["path"])
        self.path = self.path.rstrip("/")
        self.overwrite = overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        self.extensions = options.get("extensions", ",".join(EXTENSIONS)).split(",")
        if not overwrite and self._has(self.path):
            raise ValueError(f"{self.path} exists")

    def _has(self, path: str) -> bool:
        return self.system.get_file_info(path).type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        folder = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        open_name, outs, files = None, [], 0
        try:
            for name, _, content in iterator:
                if name != open_name:
                    for out in outs:
                        out.close()
                    if not files:
                        self.system.create_dir(f"{self.staging}/{folder}")
                    paths = [f"{self.staging}/{folder}/{name}.{ext}" for ext in self.extensions]
                    open_name, outs, files = name, [self.system.open_output_stream(p) for p in paths], files + len(paths)
                for out in outs:
                    out.write((content or "").encode("utf-8"))
        finally:
            for out in outs:
                out.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        done = f"{self.staging}/done"
        self.system.create_dir(done)
        for message in messages:
            if message and message.files:
                self.system.move(f"{self.staging}/{message.folder}", f"{done}/{message.folder[:5]}")
        before = f"{self.staging}/before"
        if self.overwrite and self._has(self.path):
            self.system.move(self.path, before)
        self.system.move(done, self.path)
        self.system.delete_dir(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        if self._has(self.staging):
            self.system.delete_dir(self.staging)


class BriefFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, part bigint, content string"

    def writer(self, schema, overwrite: bool) -> BriefFilesWriter:
        return BriefFilesWriter(dict(self.options), overwrite)


def write_brief_files(briefs: DataFrame, meta: DataFrame, path: str, overwrite: bool = False, extensions: tuple = EXTENSIONS) -> None:
    """briefs(conv_key, part, human_md) + meta(conv_key, title) -> path/<task>/<name>.<ext>.

    ``path`` is a folder that all executors reach, as a path or an address that pyarrow knows.
    """
    briefs.sparkSession.dataSource.register(BriefFiles)
    named = briefs.join(file_names(meta), "conv_key").select(
        "name", F.col("part").cast("bigint").alias("part"), F.col("human_md").alias("content")
    )
    # a brief is met by name in one task; its parts are read as a stream
    arranged = named.repartition("name").sortWithinPartitions("name", "part")
    writer = arranged.write.format(FORMAT).option("path", path).option("extensions", ",".join(extensions))
    writer.mode("overwrite" if overwrite else "append").save()
