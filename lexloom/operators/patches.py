"""JSON merge patches (RFC 7396) folded over any number of patches a document, without a task that reads them one after another.

A patch is cut into its writes: every object, scalar, array and null with its path. Of all writes at a path only the last
counts, and the last that was no object, since that cut off whatever stood below before. So one aggregate by document and
path, combined before the shuffle, takes the place of the walk over the patches: a document with a third of all patches
leaves one row a path. A path is alive if its last write is later than every cut above it. Only the document that results
is put together in one row, as a column of texts has to be.

Defined cases: patches are applied by rising order (null first), equal orders by a hash of the text; a patch that is null,
no JSON, nested in more than 500 levels or has half a surrogate pair is passed over, and a document with no other patch has
no row; a patch that is no object replaces the whole document, and null makes the document null; of repeated names in one
object the last counts; repeated patches count once; a null key is a document of its own. Numbers keep their digits, names
come in the order of code points.
"""

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITES = "array<struct<path:string,kind:string,value:string>>"
_WRITE = pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string())])
MOST_LEVELS = 500


class Digits(str):
    """A number as it was written."""


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=Digits, parse_int=Digits, parse_constant=_refuse)


def plain(value) -> str:
    """The compact text of a decoded value."""
    if isinstance(value, Digits):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def writes(text: str | None) -> list[tuple[str, str, str | None]]:
    """(path as a JSON pointer, object | value | null, text of the value) for each write of a patch; none if it is no JSON."""
    if text is None:
        return []
    out, waiting = [], []
    try:
        waiting.append(("", _DECODER.decode(text.strip(" \t\r\n")), 0))
        while waiting:
            path, value, level = waiting.pop()
            if level > MOST_LEVELS:
                return []
            if isinstance(value, dict):
                out.append((path, "object", None))
                waiting += [(path + "/" + k.replace("~", "~0").replace("/", "~1"), v, level + 1) for k, v in value.items()]
            else:
                out.append((path, "null", None) if value is None else (path, "value", plain(value)))
        "".join(p + (v or "") for p, _, v in out).encode()
    except (ValueError, RecursionError):
        return []
    return out


def document_text(rows: list[dict]) -> str | None:
    """The document of its living paths, in one text."""
    below: dict[str, list[str]] = {}
    of = {r["path"]: r for r in rows}
    for path in of:
        if path:
            below.setdefault(path.rsplit("/", 1)[0], []).append(path)
    if "" not in of:
        return None

    def name(path: str) -> str:
        return path.rsplit("/", 1)[1].replace("~1", "/").replace("~0", "~")

    texts: dict[str, str] = {}
    for path in sorted(of, key=lambda p: -p.count("/")):
        inner = (f"{json.dumps(name(p), ensure_ascii=False)}:{texts.pop(p)}" for p in sorted(below.get(path, []), key=name))
        texts[path] = of[path]["value"] if of[path]["kind"] == "value" else "{" + ",".join(inner) + "}"
    return texts[""]


def writes_of(patch: Column) -> Column:
    @F.arrow_udf(WRITES)
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("path", "kind", "value"), w, strict=True)) for w in writes(t.as_py())] for t in texts], pa.list_(_WRITE))

    return cut(patch)


def text_of(rows: Column) -> Column:
    @F.arrow_udf("string")
    def build(lists: pa.Array) -> pa.Array:
        return pa.array([document_text(rows.as_py() or []) for rows in lists], pa.string())

    return build(rows)


def _paths(patches: DataFrame, keys: list[str], order: str, patch: str) -> DataFrame:
    """_key, path, kind, value, alive: the last write at each path of each document."""
    rows = patches.select(F.struct(*keys).alias("_key"), F.struct(F.col(order).alias("at"), F.xxhash64(patch).alias("tie")).alias("_at"), F.explode(writes_of(F.col(patch))).alias("w"))
    rows = rows.select("_key", "_at", "w.*")
    last = rows.groupBy("_key", "path").agg(
        F.max_by(F.struct("kind", "value"), "_at").alias("last"), F.max("_at").alias("at"), F.max(F.when(F.col("kind") != "object", F.col("_at"))).alias("cut")
    )
    names = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    cuts = last.where("cut IS NOT NULL").select(F.col("_key").alias("_owner"), F.col("path").alias("_path"), F.col("cut").alias("_cut"))
    held = last.select("_key", "path", "last", "at", F.explode_outer(above).alias("above"))
    held = held.join(cuts, F.col("_key").eqNullSafe(F.col("_owner")) & (F.col("above") == F.col("_path")), "left")
    found = held.groupBy("_key", "path").agg(F.first("last").alias("last"), F.first("at").alias("at"), F.max("_cut").alias("cut"))
    return found.select("_key", "path", "last.kind", "last.value", (F.col("cut").isNull() | (F.col("at") > F.col("cut"))).alias("alive"))


def merged_documents(patches: DataFrame, keys: list[str], order: str, patch: str) -> DataFrame:
    """keys, document: the JSON text that all patches of a document leave."""
    living = F.collect_list(F.when(F.col("alive") & (F.col("kind") != "null"), F.struct("path", "kind", "value")))  # the document's own size
    found = _paths(patches, keys, order, patch).groupBy("_key").agg(living.alias("rows"))
    return found.select("_key.*", text_of(F.col("rows")).alias("document"))


def leaves(documents: DataFrame, keys: list[str], document: str = "document") -> DataFrame:
    """keys, path, kind, value of each object, scalar, array and null of JSON texts."""
    return documents.select(*keys, F.explode(writes_of(F.col(document))).alias("w")).select(*keys, "w.*")
