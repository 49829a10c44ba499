"""Code facts: one nested record for each source file, and the tables they expand to.

Facts are an input contract: something that parses and type-checks source writes
them as JSON or Parquet; nothing here parses code. A symbol's id is its file,
name and first line, so ids survive reloading and need no lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "struct<file:string,name:string,start_line:int>"
LOCAL_KEY = "struct<name:string,start_line:int>"
HANDLER = f"struct<kind:string,key:{KEY},arity:int,text:string,factory:{KEY},receiver_key:string,package:string>"
SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,exported:boolean,signature:string>"
CALL = f"struct<caller:{LOCAL_KEY},callee:{KEY},callee_text:string,line:int,resolved:boolean>"
IMPORT = "struct<imported_path:string,resolved_path:string,imported_names:array<string>,package_name:string,package_version:string>"
ROUTER_CALL = f"struct<receiver:struct<key:string,kind:string>,receiver_text:string,call_kind:string,method:string,path:string,path_text:string,line:int,end_line:int,order_idx:int,handlers:array<{HANDLER}>>"
EFFECT = f"struct<symbol:{LOCAL_KEY},kind:string,detail:string,line:int>"
REACT = (
    f"struct<symbol:{LOCAL_KEY},props_type:string,props:array<string>,"
    "state:array<struct<name:string,setter:string,hook:string,initial:string,line:int>>,"
    f"hooks:array<struct<name:string,line:int,callee:{KEY},package:string,bindings:array<string>,callbacks:array<struct<name:string,line:int>>>>,"
    "context:array<struct<context:string,line:int,bindings:array<string>>>,"
    "effects:array<struct<hook:string,line:int,end_line:int,deps:array<string>,binding:string>>,"
    f"render:array<struct<element:string,kind:string,line:int,depth:int,component:{KEY},package:string,props:array<struct<name:string,value:string>>,condition:string>>,"
    f"handlers:array<struct<element:string,event:string,handler:string,line:int,end_line:int,target:{KEY}>>>"
)
API_CALL = f"struct<symbol:{LOCAL_KEY},method:string,url_pattern:string,url_text:string,line:int>"
REFERENCE = "struct<kind:string,name:string,line:int,ref_file:string,ref_line:int,ref_end_line:int>"

#: One record for each file. Lists that are absent count as empty. ``declarations`` are the types and module values a line uses.
FACTS = (
    f"path string, hash string, language string, symbols array<{SYMBOL}>, calls array<{CALL}>, imports array<{IMPORT}>, router_calls array<{ROUTER_CALL}>, "
    f"side_effects array<{EFFECT}>, react_facts array<{REACT}>, api_calls array<{API_CALL}>, declarations array<{REFERENCE}>, text string"
)

TABLES = ["files", "symbols", "calls", "imports", "router_calls", "side_effects", "components", "api_calls", "declarations"]


class FactsError(ValueError):
    """Facts that name what does not exist; nothing is published then."""


def read_facts(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Facts from JSON lines or Parquet, under the fixed schema."""
    return spark.read.schema(FACTS).format(form).load(path)


def symbol_id(file: Column, name: Column, start_line: Column) -> Column:
    """The id of a symbol; null if any part is."""
    return F.concat(file, F.lit("#"), name, F.lit("@"), start_line.cast("string"))


def key_id(key: Column) -> Column:
    return symbol_id(key["file"], key["name"], key["start_line"])


def expand(facts: DataFrame, resolve_in: DataFrame | None = None, checked: bool = True) -> dict[str, DataFrame]:
    """The base tables of facts.

    ``resolve_in`` has further symbols (symbol_id) that calls may lead to. A call
    whose callee is not known is kept, unresolved; one whose caller is not known,
    and an effect, component or API call of an unknown symbol, raise FactsError.
    """
    each = lambda column: facts.select(F.col("path").alias("file"), F.posexplode(column).alias("position", "f"))
    local = lambda who: symbol_id(F.col("file"), F.col(f"f.{who}.name"), F.col(f"f.{who}.start_line"))
    symbols = each("symbols").select(symbol_id(F.col("file"), F.col("f.name"), F.col("f.start_line")).alias("symbol_id"), "file", "f.*")
    known = symbols.select("symbol_id")
    everywhere = known if resolve_in is None else known.unionByName(resolve_in.select("symbol_id")).distinct()
    calls = each("calls").select("file", "position", local("caller").alias("caller_id"), key_id(F.col("f.callee")).alias("_callee"), F.col("f.callee_text").alias("callee_text"), F.col("f.line").alias("call_line"), F.col("f.resolved").alias("_resolved"))
    calls = calls.join(everywhere.select(F.col("symbol_id").alias("callee_id")), F.col("_callee") == F.col("callee_id"), "left")
    calls = calls.select("file", "position", "caller_id", "callee_id", "callee_text", "call_line", (F.col("_resolved") & (F.col("_callee").isNull() | F.col("callee_id").isNotNull())).alias("resolved"))
    owned = lambda column: each(column).withColumn("symbol_id", local("symbol"))
    tables = {
        "files": facts.select("path", "hash", "language"),
        "symbols": symbols,
        "calls": calls,
        "imports": each("imports").select("file", "position", "f.*"),
        "router_calls": each("router_calls").select(
            F.concat_ws(":", "file", F.lpad(F.col("position").cast("string"), 6, "0")).alias("seq"), "file", F.col("f.receiver.key").alias("receiver_key"), F.col("f.receiver.kind").alias("receiver_kind"),
            *(f"f.{c}" for c in ("receiver_text", "call_kind", "method", "path", "path_text", "line", "end_line", "order_idx", "handlers")),
        ),
        "side_effects": owned("side_effects").select("file", "position", "symbol_id", *(f"f.{c}" for c in ("kind", "detail", "line"))),
        "components": owned("react_facts").select("file", "symbol_id", *(f"f.{c}" for c in ("props_type", "props", "state", "hooks", "context", "effects", "render", "handlers"))),
        "api_calls": owned("api_calls").select(F.concat_ws(":", "file", F.lpad(F.col("position").cast("string"), 6, "0")).alias("api_call_id"), "file", "symbol_id", *(f"f.{c}" for c in ("method", "url_pattern", "url_text", "line"))),
        "declarations": each("declarations").select("file", "position", "f.*"),
    }
    if checked:
        check_owners(tables, everywhere)
    return tables


def check_owners(tables: dict[str, DataFrame], known: DataFrame) -> None:
    """FactsError if a fact belongs to a symbol that is not in ``known`` (symbol_id)."""
    lost = missing_owners(tables, known).collect()
    if lost:
        raise FactsError("; ".join(f"{r.n} rows of {r.t} belong to unknown symbols" for r in sorted(lost)))


def missing_owners(tables: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """(t, n): for each table how many of its facts belong to a symbol that is not in ``known`` (symbol_id), if any do."""
    owners = [tables["calls"].select(F.lit("calls").alias("t"), F.col("caller_id").alias("symbol_id"))]
    owners += [tables[t].select(F.lit(t).alias("t"), "symbol_id") for t in ("side_effects", "components", "api_calls")]
    everyone = owners[0]
    for more in owners[1:]:
        everyone = everyone.unionByName(more)
    return everyone.join(known, "symbol_id", "left_anti").groupBy("t").agg(F.count("*").alias("n"))


def scan_tree(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """(path, hash, language, text): source files under a directory, by extension, without dependencies, type stubs and ignored globs."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,mts,cts,js,jsx,mjs,cjs}").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.col("path"), f"^(?:[a-z]+:/*)?/?{base.lstrip('/')}/", "")
    files = found.select(path.alias("path"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))
    files = files.where(~F.col("path").rlike(r"(^|/)node_modules/|\.d\.[mc]?ts$"))
    for glob in ignore:
        pattern = glob.replace(".", r"\.").replace("**/", "\0").replace("**", "\1").replace("*", "[^/]*").replace("\0", "(?:.*/)?").replace("\1", ".*")
        files = files.where(~F.col("path").rlike(f"^{pattern}$"))
    language = F.when(F.col("path").rlike(r"\.[mc]?tsx?$"), "typescript").otherwise("javascript")
    return files.dropDuplicates(["path"]).select("path", "hash", language.alias("language"), "text")


def package_versions(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """(package, directory, version): as seen from each directory, the nearest installed version, else the nearest declared range.

    ``wanted`` has package and directory, ``manifests`` package, directory (where
    its node_modules or manifest lies), version and installed.
    """
    parts = F.split("directory", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "/").alias("above"), n.alias("distance")))
    climbing = wanted.select("package", "directory", F.explode(ups).alias("u")).select("package", "directory", F.col("u.above").alias("above"), F.col("u.distance").alias("distance")).distinct()
    joined = climbing.join(manifests.withColumnRenamed("directory", "above"), ["package", "above"])
    return joined.groupBy("package", "directory").agg(F.min_by("version", F.struct((~F.col("installed")).alias("declared"), "distance")).alias("version"))


