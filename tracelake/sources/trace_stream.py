"""Binary trace streams as tables: a Python data source and the normalization to a ``Trace``.

    spark.dataSource.register(TraceStreamSource)
    records = spark.read.format("trace_stream").load("/recordings")
    trace = normalize(records)

A file is one partition, as its dictionaries only hold within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.sources import lz4_frame, wire
from tracelake.schema import Trace

STATE = "struct<state:string,bytes:binary>"
REGISTER = "array<struct<slot:int,width:int,name:string>>"
RECORDS = (
    "artifact string, record_ordinal bigint, source_offset bigint, kind string, sequence bigint, tid bigint, module bigint, module_base bigint, "
    "module_name string, relative_pc bigint, definition bigint, opcode bigint, read_mask bigint, write_mask bigint, displacement bigint, flags bigint, "
    "pc_kind int, condition int, slow_memory_path int, mnemonic string, operands string, disassembly string, "
    f"reads {REGISTER}, writes {REGISTER}, "
    "memory_operands array<struct<base:int,index:int,extend:int,address_mode:int,shift:int,access_kind:int,writeback:int,access_size:bigint,displacement:bigint>>, "
    "read_values array<bigint>, write_values array<bigint>, direction string, metadata_available boolean, access_flags bigint, address bigint, size bigint, "
    f"value bigint, before {STATE}, after {STATE}, category string, name string, detail string, "
    "begin struct<module_base:bigint,target_offset:bigint,target_address:bigint,pid:bigint,profile:string,compressed:boolean,effective_buffer_bytes:bigint,run_id:bigint,scene:string,target:string>, "
    "terminal struct<status:string,reason:string,return_value:bigint," + ",".join(f"{c}:bigint" for c in wire.COUNTERS) + ">, failure string"
)


def list_files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The files at or under a path, in any file system that Arrow knows; a plain path is local."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return fs, [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def batches(rows: Iterator[dict], schema, size: int = 8192) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Rows as Arrow batches, column by column; rows that were read before a fault are given out first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    held: list[dict] = []

    def made() -> pa.RecordBatch:
        columns = [pa.array([r.get(f.name) for r in held], type=f.type) for f in out]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


class _File(InputPartition):
    def __init__(self, uri: str, path: str) -> None:
        self.uri, self.path = uri, path


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:  # noqa: ANN001
        self._schema = schema
        self._uri = options["path"]
        self._partial = str(options.get("partial", "false")).lower() == "true"
        self._tolerant = str(options.get("tolerant", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(self._uri, p) for p in list_files(self._uri)[1]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return batches(self._rows(partition), self._schema)

    def _rows(self, partition: _File) -> Iterator[dict]:
        fs, _ = pafs.FileSystem.from_uri(partition.uri) if "://" in partition.uri else (pafs.LocalFileSystem(), "")
        with fs.open_input_stream(partition.path) as f:
            data = f.read()
        artifact = partition.path.rsplit("/", 1)[-1]
        try:
            cut = False
            if not data.startswith(wire.MAGIC):
                data, cut = lz4_frame.decode_frames(data)
            for row in wire.decode(data, self._partial or cut):
                row["artifact"] = artifact
                yield row
        except ValueError as e:
            if not self._tolerant:
                raise ValueError(f"{artifact}: {e}") from e
            yield {"artifact": artifact, "kind": "failure", "failure": str(e)}


class TraceStreamSource(DataSource):
    """Options: ``partial`` (complete records of cut streams), ``tolerant`` (a failure row instead of an error)."""

    @classmethod
    def name(cls) -> str:
        return "trace_stream"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _Reader(schema, self.options)


CONTROL = ("module_definition", "instruction_definition", "begin", "failure")


def normalize(records: DataFrame) -> Trace:
    """The star tables of decoded records.  ``source_row`` is dense in stored order within an artifact."""
    from pyspark.sql import Window

    zero = F.lit(0).cast("bigint")
    visible = records.where("kind <> 'failure'")
    place = F.row_number().over(Window.partitionBy("artifact").orderBy("record_ordinal")) - 1  # a file is one partition already
    tids = records.where("kind = 'begin'").select("artifact", F.col("tid").alias("run_tid"))
    rows = visible.withColumn("source_row", place.cast("bigint")).join(tids, "artifact", "left").withColumn("owner_row", F.col("source_row"))
    kind = F.when(F.col("kind") == "truncation", "discontinuity").otherwise(F.col("kind"))
    damaged = F.when(F.col("kind") == "truncation", "damaged").otherwise("captured")
    tid = F.coalesce("tid", "run_tid")
    events = rows.select("artifact", zero.alias("timeline"), "record_ordinal", "source_offset", "sequence", tid.alias("tid"), "source_row", kind.alias("kind"), damaged.alias("provenance"))
    modules = rows.where("kind = 'module_definition'").select("artifact", "module", F.col("module_base").alias("base"), F.col("module_name").alias("name")).dropDuplicates(["artifact", "module"])  # a definition may be repeated
    definitions = rows.where("kind = 'instruction_definition'").select(
        "artifact", "definition", "opcode", "read_mask", "write_mask", "displacement", "flags", "pc_kind", "condition", "slow_memory_path", "mnemonic", "operands", "disassembly", "reads", "writes", "memory_operands"
    ).dropDuplicates(["artifact", "definition"])
    instructions = rows.where("kind = 'instruction'").select("artifact", "owner_row", "module", "relative_pc", "definition", "read_values", "write_values")
    end = _end(F.col("address"), F.col("size"))
    memory = rows.where("kind = 'memory'").select(
        "artifact", zero.alias("timeline"), "owner_row", F.col("source_row").alias("row"), tid.alias("tid"), "module", "relative_pc", "address", end.alias("end_exclusive"), "size", "direction", "metadata_available",
        F.col("access_flags").alias("flags"), "value", "before", "after",
    )
    semantics = rows.where("kind LIKE 'semantic_%'").select("artifact", "owner_row", "category", "name", "detail")
    gaps = rows.where("kind = 'truncation'").select("artifact", zero.alias("timeline"), F.col("source_row").alias("row"), F.lit(None).cast("bigint").alias("tid"), F.lit("source_bytes").alias("domain"), F.col("source_offset").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
    return Trace(events, modules, definitions, instructions, memory, semantics, register_observations(events, instructions, definitions), gaps)


def _end(address: Column, size: Column) -> Column:
    """address + size as a pattern; null stands for 2**64."""
    from tracelake.functions.u64 import checked_add

    return checked_add(address, size)


def register_observations(events: DataFrame, instructions: DataFrame, definitions: DataFrame) -> DataFrame:
    """A row for each register that an instruction read or wrote, in wire order."""
    joined = instructions.join(definitions.select("artifact", "definition", "reads", "writes"), ["artifact", "definition"])
    who = events.select("artifact", "timeline", "tid", F.col("source_row").alias("owner_row"))

    def side(values: str, names: str, access: str) -> DataFrame:
        pairs = F.arrays_zip(F.col(values).alias("value"), F.col(names).alias("register"))
        return joined.select("artifact", "owner_row", F.posexplode(pairs).alias("obs_ordinal", "x")).select(
            "artifact", "owner_row", "obs_ordinal", F.col("x.register.slot").alias("slot"), F.col("x.register.width").alias("captured_width"), F.lit(access).alias("access"),
            F.col("x.value").alias("value"), F.lit("captured").alias("provenance"), F.col("x.register.name").alias("name"),
        )

    rows = side("read_values", "reads", "read").unionByName(side("write_values", "writes", "write"))
    return rows.join(who, ["artifact", "owner_row"]).withColumn("row", F.col("owner_row"))
