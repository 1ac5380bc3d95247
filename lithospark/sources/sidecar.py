"""What a table's columns are, kept in a small text beside it: roles by column number, the no-data value, grid geometry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.sources.geoeas import number_text
from lithospark.spec import GridSpec

#: Keys of a grid's geometry, in the order in which they are written (fixed values).
GEOMETRY = ("X0", "Y0", "Z0", "NX", "NY", "NZ", "DX", "DY", "DZ")


@dataclass
class TableInfo:
    """Column numbers count from 1, 0 is none. weights: weight to variable; scores: normal score to (variable, transform
    table); categories: variable to the name of its code list. spec is that of a grid, with rotation and realizations."""

    x: int = 0
    y: int = 0
    z: int = 0
    ndv: str = ""
    weights: dict[int, int] = field(default_factory=dict)
    scores: dict[int, tuple[int, str]] = field(default_factory=dict)
    categories: dict[int, str] = field(default_factory=dict)
    spec: GridSpec | None = None
    rotation: float = 0.0
    realizations: int = 1

    def name(self, table: DataFrame, number: int) -> str:
        """Column name of a number; row_id is no column of the file."""
        return [c for c in table.columns if c != "row_id"][number - 1]

    def places(self, table: DataFrame) -> DataFrame:
        """table with x, y, z copied from the columns that hold them, as far as they are named."""
        found = {c: F.col(self.name(table, n)) for c, n in (("x", self.x), ("y", self.y), ("z", self.z)) if n}
        return table.withColumns(found)

    def known(self, table: DataFrame) -> DataFrame:
        """table with null for the no-data value."""
        if not self.ndv:
            return table
        lost = float(self.ndv)
        return table.withColumns({c: F.when(F.col(c) != lost, F.col(c)) for c in table.columns if c != "row_id"})


def read_sidecar(spark: SparkSession, path: str) -> TableInfo:
    """Lines of other keys, and of keys without a value, are skipped; the last line of a key counts."""
    out, shape = TableInfo(), {}
    for line in (r["value"] for r in spark.read.text(path).collect()):  # a few lines
        key, colon, value = line.partition(":")
        value = value.strip()
        if not colon or not value:
            continue
        if key in ("X", "Y", "Z"):
            setattr(out, key.lower(), int(value))
        elif key == "NDV":
            out.ndv = value
        elif key == "WEIGHT":
            variable, _, weight = value.partition(">")
            out.weights[int(weight)] = int(variable)
        elif key == "NSCORE":
            variable, _, pair = value.partition(">")
            score, _, name = pair.partition("=")
            out.scores[int(score)] = (int(variable), name)
        elif key == "CATEGORICAL":
            variable, _, name = value.partition(",")
            out.categories[int(variable)] = name
        elif key == "ROT":
            out.rotation = float(value)
        elif key == "NREAL":
            out.realizations = int(value)
        elif key in GEOMETRY:
            shape[key] = float(value)
    if {"NX", "NY"} <= shape.keys():
        dx, dy, dz = (shape.get(k, 1.0) for k in ("DX", "DY", "DZ"))
        corner = [shape.get(k, 0.0) - d / 2 for k, d in (("X0", dx), ("Y0", dy), ("Z0", dz))]  # the file has the first cell's center
        out.spec = GridSpec(int(shape["NX"]), int(shape["NY"]), int(shape.get("NZ", 1)), *corner, dx, dy, dz)
    return out


def write_sidecar(spark: SparkSession, info: TableInfo, path: str) -> None:
    """One text part; read_sidecar() gives the same info back."""
    lines: list[tuple[str, float | int | str]] = []
    if info.spec:
        s = info.spec
        lines += zip(GEOMETRY, (s.x0 + s.dx / 2, s.y0 + s.dy / 2, s.z0 + s.dz / 2, s.nx, s.ny, s.nz, s.dx, s.dy, s.dz))
        lines += [("ROT", info.rotation), ("NREAL", info.realizations)]
    else:
        lines += [("X", info.x), ("Y", info.y), ("Z", info.z)]
    lines += [("NDV", info.ndv)]
    lines += [("WEIGHT", f"{v}>{w}") for w, v in info.weights.items()]
    lines += [("NSCORE", f"{v}>{n}={t}") for n, (v, t) in info.scores.items()]
    lines += [("CATEGORICAL", f"{v},{n}") for v, n in info.categories.items()]
    text = "\n".join(["metadata", *(f"{k}:{v:.12g}" if isinstance(v, float) else f"{k}:{v}" for k, v in lines)])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """from, to, n of a matrix file: a line of column names, then lines of a name and its numbers; names may be in double quotes.

    The names of the first line are taken from its head; rows with another number of fields are skipped."""
    fields = F.expr(r"""transform(regexp_extract_all(value, '("[^"]*"|[^\\s"]+)', 1), x -> replace(x, '"', ''))""")
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("_m"), fields.alias("f"))
    head = lines.orderBy("_m").limit(1).first()
    if head is None:
        return spark.createDataFrame([], "from string, to string, n double")
    names = F.array(*[F.lit(c) for c in head["f"]])
    rows = lines.where((F.col("_m") != head["_m"]) & (F.size("f") == len(head["f"]) + 1))
    return rows.select(F.col("f")[0].alias("from"), F.posexplode(F.slice("f", 2, len(head["f"]))).alias("p", "v")).select("from", F.element_at(names, F.col("p") + 1).alias("to"), F.expr("try_cast(v AS double)").alias("n"))


def write_matrix(matrix: DataFrame, categories: list[str], path: str) -> None:
    """from, to, n as a matrix file in the order of categories; pairs that are not there are 0."""
    quoted = lambda c: F.when(c.rlike(r"\s"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    order = matrix.sparkSession.createDataFrame(list(enumerate(categories)), "_o int, from string")
    sums = matrix.groupBy(F.col("from").cast("string").alias("from")).agg(*[F.sum(F.when(F.col("to").cast("string") == c, F.col("n"))).alias(f"_{k}") for k, c in enumerate(categories)])
    cells = [number_text(F.coalesce(F.col(f"_{k}").cast("double"), F.lit(0.0))) for k in range(len(categories))]
    body = order.join(F.broadcast(sums), "from", "left").select("_o", F.concat_ws("\t", quoted(F.col("from")), *cells).alias("value"))  # a row a category
    head = order.agg(F.sort_array(F.collect_list(F.struct("_o", quoted(F.col("from")).alias("c")))).alias("_h")).select(F.lit(-1).alias("_o"), F.concat(F.lit("\t"), F.array_join("_h.c", "\t")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("_o").select("value").write.text(path)


def write_grd(grid: DataFrame, spec: GridSpec, path: str, value: str = "v", ndv: float = -999.0) -> None:
    """An ASCII DSAA grid of one layer in sorted text parts: size, edges, least and largest value, then a line a row, bottom row first.

    Lost and absent cells are ndv; least and largest are those of the known ones."""
    cells = F.sort_array(F.collect_list(F.struct("i", F.coalesce(F.col(value).cast("double"), F.lit(ndv)).alias("v"))))
    held = grid.where(F.col("i").between(0, spec.nx - 1) & F.col("j").between(0, spec.ny - 1)).groupBy("j").agg(F.map_from_entries(cells).alias("m"))
    row = F.transform(F.sequence(F.lit(0), F.lit(spec.nx - 1)), lambda i: number_text(F.coalesce(F.element_at("m", i), F.lit(ndv))))
    rows = grid.sparkSession.range(spec.ny).select(F.col("id").cast("int").alias("j")).join(held, "j", "left")
    body = rows.select(F.col("j").cast("double").alias("_o"), F.array_join(F.when(F.col("m").isNull(), F.array_repeat(number_text(F.lit(ndv)), spec.nx)).otherwise(row), " ").alias("value"))
    ends = grid.agg(F.min(F.col(value).cast("double")).alias("a"), F.max(F.col(value).cast("double")).alias("b"))
    edges = [f"{a:.12g} {b:.12g}" for a, b in ((spec.x0, spec.x0 + spec.nx * spec.dx), (spec.y0, spec.y0 + spec.ny * spec.dy))]
    text = F.concat_ws("\n", F.lit("DSAA"), F.lit(f"{spec.nx} {spec.ny}"), *map(F.lit, edges), F.concat_ws(" ", number_text(F.coalesce("a", F.lit(ndv))), number_text(F.coalesce("b", F.lit(ndv)))))
    head = ends.select(F.lit(float("-inf")).alias("_o"), text.alias("value"))
    head.unionByName(body).repartitionByRange("_o").sortWithinPartitions("_o").select("value").write.text(path)
