"""Readers and writers: text corpora, archives, molecule libraries, structures, JSON lines."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never walked, and extensions read by default. Fixed values.
SKIP_DIRS = (".git", "node_modules", "target", "build", "dist", "__pycache__", ".venv")
EXTENSIONS = ("md", "markdown", "txt", "rst", "rs", "py", "ts", "js", "go", "c", "h", "cpp", "hpp", "java", "json", "toml", "yaml", "yml", "sql", "sh", "html", "css")


def corpus(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, bytes, modified, text) of the text files below `root`: by extension, whatever its
    case, up to a size; bytes that aren't UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    skip = "|".join(re.escape(d) for d in SKIP_DIRS)
    kept = files.where(ext.isin(*extensions) & (F.col("length") <= max_bytes) & ~F.rlike("path", F.lit(f"/({skip})/")))
    return kept.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), _text(F.col("content")).alias("text"))


def _text(content):  # noqa: ANN001, ANN202
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return F.pandas_udf(run, "string")(content)


def archive_kind(path: str) -> str | None:
    low = path.lower()
    for end, kind in ((".zip", "zip"), (".tar.gz", "tar"), (".tgz", "tar"), (".tar.zst", "tarzst"), (".tar", "tar"), (".gz", "gz"), (".zst", "zst")):
        if low.endswith(end):
            return kind
    return None


def entries(path: str, data: bytes, max_entry: int = 64 << 20) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(entry, bytes, content, error) of an archive; entries over the limit have no content."""
    kind = archive_kind(path)
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, z.read(i) if i.file_size <= max_entry else None, None
        elif kind in ("tar", "tarzst"):
            if kind == "tarzst":
                import zstandard

                data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, m.size, t.extractfile(m).read() if m.size <= max_entry else None, None
        elif kind in ("gz", "zst"):
            name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if kind == "gz":
                import gzip

                out = gzip.decompress(data)
            else:
                import zstandard

                out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
            yield name, len(out), out if len(out) <= max_entry else None, None
    except Exception as e:  # a broken archive is a row with its error, not a failed job
        yield "", 0, None, f"{type(e).__name__}: {e}"


def archives(spark: SparkSession, root: str, max_entry: int = 64 << 20) -> DataFrame:
    """(path, entry, bytes, text, error): entries of the archives below `root` as files ``archive::entry``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"{p}::{n}", n, size, None if c is None else c.decode("utf-8", "replace"), err) for p, d in zip(pdf["path"], pdf["content"], strict=True) for n, size, c, err in entries(p, bytes(d), max_entry)]
            yield pd.DataFrame(rows, columns=["path", "entry", "bytes", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.rlike(F.lower("path"), F.lit(r"\.(zip|tar|tgz|gz|zst)$")))
    return files.select("path", "content").mapInPandas(run, "path string, entry string, bytes bigint, text string, error string")


def split_virtual(path: str) -> tuple[str, str] | None:
    """Archive and entry of a path ``archive::entry``."""
    a, mark, e = path.partition("::")
    return (a, e) if mark and archive_kind(a) and e else None


def parse_sdf(text: str) -> Iterator[dict]:
    """Molecules of an SDF file: name, atoms (symbol, x, y, z), bonds (a, b, order), data."""
    for block in re.split(r"^\$\$\$\$[ \t]*$", text.replace("\r\n", "\n"), flags=re.M):
        lines = block.strip("\n").split("\n")
        counts = next((i for i, x in enumerate(lines[:6]) if "V2000" in x), None)
        if counts is None:
            continue
        try:
            n_atoms, n_bonds = int(lines[counts][:3]), int(lines[counts][3:6])
            atoms = [(x[31:34].strip(), float(x[:10]), float(x[10:20]), float(x[20:30])) for x in lines[counts + 1 : counts + 1 + n_atoms]]
            bonds = [(int(x[:3]), int(x[3:6]), int(x[6:9])) for x in lines[counts + 1 + n_atoms : counts + 1 + n_atoms + n_bonds]]
        except (ValueError, IndexError):
            continue
        data = dict(re.findall(r"^> *<([^>]+)>[^\n]*\n(.*?)(?=\n\n|\n> *<|\Z)", "\n".join(lines[counts:]), re.M | re.S))
        yield {"name": lines[counts - 3].strip() if counts >= 3 else "", "atoms": atoms, "bonds": bonds, "data": data}


_SDF = "path string, idx int, name string, atoms array<struct<symbol:string,x:double,y:double,z:double>>, bonds array<struct<a:int,b:int,order:int>>, data map<string,string>"


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """Molecules of the SDF files at `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                for i, m in enumerate(parse_sdf(t)):
                    rows.append((p, i, m["name"], [{"symbol": s, "x": x, "y": y, "z": z} for s, x, y, z in m["atoms"]], [{"a": a, "b": b, "order": o} for a, b, o in m["bonds"]], m["data"]))
            yield pd.DataFrame(rows, columns=["path", "idx", "name", "atoms", "bonds", "data"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).mapInPandas(run, _SDF)


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB files by their fixed columns."""
    t = spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    a = t.where(F.rlike("value", F.lit(r"^(ATOM  |HETATM)")))
    cut = lambda i, n: F.trim(F.substring("value", i, n))
    num = lambda i, n, k: F.expr(f"try_cast(trim(substring(value, {i}, {n})) AS {k})")
    return a.select(
        "path", cut(1, 6).alias("record"), num(7, 5, "int").alias("serial"), cut(13, 4).alias("name"), cut(18, 3).alias("res_name"), cut(22, 1).alias("chain"), num(23, 4, "int").alias("res_seq"),
        num(31, 8, "double").alias("x"), num(39, 8, "double").alias("y"), num(47, 8, "double").alias("z"), num(55, 6, "double").alias("occ"), num(61, 6, "double").alias("b"), cut(77, 2).alias("element"),
    )


def parse_mmcif(text: str) -> Iterator[dict[str, str]]:
    """Rows of the atom loop of an mmCIF file, by field name without the category."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.strip() != "loop_":
            continue
        fields: list[str] = []
        row = next(lines, "")
        while row.strip().startswith("_"):
            fields.append(row.split()[0].lower())
            row = next(lines, "")
        if "_atom_site.cartn_x" not in fields:
            continue
        names = [f.split(".", 1)[1] for f in fields]
        while row.strip() and not row.startswith(("#", "_", "loop_", "data_")):
            cells = [a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", row)]
            if len(cells) == len(names):
                yield dict(zip(names, cells, strict=True))
            row = next(lines, "")


def mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of mmCIF files, with the columns of :func:`pdb`."""
    cols = ["path", "record", "serial", "name", "res_name", "chain", "res_seq", "x", "y", "z", "occ", "b", "element"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def num(v: str | None, kind: type) -> float | int | None:
            try:
                return kind(v)
            except (TypeError, ValueError):
                return None

        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                for a in parse_mmcif(t):
                    chain, seq = a.get("auth_asym_id") or a.get("label_asym_id"), a.get("auth_seq_id") or a.get("label_seq_id")
                    rows.append((p, a.get("group_pdb", "ATOM"), num(a.get("id"), int), a.get("label_atom_id"), a.get("label_comp_id"), chain, num(seq, int), *(num(a.get(k), float) for k in ("cartn_x", "cartn_y", "cartn_z", "occupancy", "b_iso_or_equiv")), a.get("type_symbol")))
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({"serial": "Int64", "res_seq": "Int64"})

    schema = "path string, record string, serial int, name string, res_name string, chain string, res_seq int, x double, y double, z double, occ double, b double, element string"
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).mapInPandas(run, schema)


def sqlite_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(path, row): the rows of a table of SQLite files as JSON, read in memory where the file is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import sqlite3

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(data))
                cur = con.execute('SELECT * FROM "' + table.replace('"', '""') + '"')
                names = [c[0] for c in cur.description]
                while part := cur.fetchmany(5000):
                    yield pd.DataFrame({"path": p, "row": [json.dumps(dict(zip(names, r, strict=True)), ensure_ascii=False, default=lambda b: b.hex()) for r in part]})
                con.close()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row string")


def pdb_info(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("path").agg(F.count("*").alias("atoms"), F.countDistinct("chain").alias("chains"), F.countDistinct("chain", "res_seq").alias("residues"), F.round(F.avg("b"), 4).alias("mean_b"))


def _shift(cell: Column) -> Callable[[Column], Column]:
    return lambda d: cell + d


def within_radius(atoms: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Atoms within `radius` of the centres (cx, cy, cz) by cells of that width and exact distance."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    a = atoms.withColumn("i", cell("x")).withColumn("j", cell("y")).withColumn("k", cell("z"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    c = centres
    for src, dst in (("cx", "i"), ("cy", "j"), ("cz", "k")):
        c = c.withColumn(dst, F.explode(F.transform(near, _shift(cell(src)))))
    j = a.join(c, ["i", "j", "k"]).drop("i", "j", "k")
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
    return j.withColumn("dist", F.sqrt(d2)).where(F.col("dist") <= radius)


def checked_edges(edges: DataFrame) -> DataFrame:
    """(issue, n): what is wrong with a table of edges: nulls, negative weights, double edges, unknown classes."""
    bad = edges.agg(
        F.sum((F.col("src").isNull() | F.col("dst").isNull()).cast("int")).alias("null_end"), F.sum((F.col("weight") < 0).cast("int")).alias("negative_weight"), F.sum((~F.col("cls").between(0, 5)).cast("int")).alias("unknown_class")
    )
    double = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("double_edge"))
    both = bad.crossJoin(F.broadcast(double))
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("issue"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n")) for c in both.columns])))


def write_lines(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Results as JSON lines, markdown sections or plain text."""
    if fmt == "jsonl":
        df.write.mode("overwrite").json(path)
        return
    cols = df.columns
    body = F.concat_ws("\n", *[F.concat(F.lit(f"- **{c}**: " if fmt == "markdown" else f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols[1:]])
    head = F.concat(F.lit("## " if fmt == "markdown" else ""), F.col(cols[0]).cast("string"))
    df.select(F.concat_ws("\n", head, body, F.lit("")).alias("value")).write.mode("overwrite").text(path)
