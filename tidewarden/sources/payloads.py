"""Readers of chat-shaped JSON payloads into flat tables, and reshaping between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "struct<type:string,text:string,image_url:struct<url:string>>"
CHAT = f"struct<model:string,messages:array<struct<role:string,source:string,content:string,parts:array<{_PART}>>>>"
MESSAGES = f"struct<model:string,system:array<struct<type:string,text:string>>,messages:array<struct<role:string,content:array<{_PART}>>>>"
RESPONSES = f"struct<model:string,input:array<struct<role:string,type:string,content:array<{_PART}>,call_id:string,name:string,arguments:string,output:string>>>"
TOOL_CALLS = "array<struct<type:string,name:string,arguments:string,function:struct<name:string,arguments:string>,input:string>>"


def flatten_parts(parts: Column) -> Column:
    """One text of content parts; parts that are no text become marks."""

    def one(p: Column) -> Column:
        return (
            F.when(p["type"].isin("text", "input_text", "output_text"), F.coalesce(p["text"], F.lit("")))
            .when(p["type"].isin("image_url", "input_image", "image"), F.lit("[IMAGE_CONTENT]"))
            .otherwise(F.concat(F.lit("[NON_TEXT_PART:"), F.coalesce(p["type"], F.lit("unknown")), F.lit("]")))
        )

    return F.trim(F.regexp_replace(F.array_join(F.transform(parts, one), " "), r"\s+", " "))


def _source(role: Column, source: Column) -> Column:
    return F.coalesce(source, F.when(role == "system", F.lit("system")).otherwise(F.lit("user")))


def read_chat(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Chat payloads as ``id, msg_idx, role, source, content``; rows that can't be parsed give no messages."""
    p = df.select(id_col, F.from_json(json_col, CHAT).alias("p")).select(id_col, F.posexplode("p.messages").alias("msg_idx", "m"))
    content = F.coalesce("m.content", flatten_parts(F.col("m.parts")))
    return p.select(id_col, "msg_idx", "m.role", _source(F.col("m.role"), F.col("m.source")).alias("source"), content.alias("content"))


def read_messages_api(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Payloads with a system prompt of their own, which becomes the first message."""
    p = df.select(id_col, F.from_json(json_col, MESSAGES).alias("p"))
    system = F.when(F.size("p.system") > 0, F.array(F.struct(F.lit("system").alias("role"), F.array_join(F.transform("p.system", lambda s: s["text"]), "\n").alias("content"))))
    rest = F.transform("p.messages", lambda m: F.struct(m["role"].alias("role"), flatten_parts(m["content"]).alias("content")))
    rows = p.select(id_col, F.posexplode(F.concat(F.coalesce(system, F.array().cast("array<struct<role:string,content:string>>")), rest)).alias("msg_idx", "m"))
    return rows.select(id_col, "msg_idx", "m.role", _source(F.col("m.role"), F.lit(None)).alias("source"), "m.content")


def read_responses_api(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Payloads whose ``input`` is one string or a list of items."""
    v = df.select(id_col, json_col, F.get_json_object(json_col, "$.input").alias("i"))
    single = v.where(~F.col("i").startswith("[")).select(id_col, F.lit(0).alias("msg_idx"), F.lit("user").alias("role"), F.lit("user").alias("source"), F.col("i").alias("content"))
    p = v.where(F.col("i").startswith("[")).select(id_col, F.from_json(json_col, RESPONSES).alias("p")).select(id_col, F.posexplode("p.input").alias("msg_idx", "m"))
    role = F.coalesce("m.role", F.when(F.col("m.type").startswith("function_call"), F.lit("tool")).otherwise(F.lit("user")))
    content = F.coalesce(F.when(F.size("m.content") > 0, flatten_parts(F.col("m.content"))), F.col("m.output"), F.concat_ws(" ", "m.name", "m.arguments"))
    listed = p.select(id_col, "msg_idx", role.alias("role"), F.when(role == "tool", F.lit("tool")).otherwise(_source(role, F.lit(None))).alias("source"), content.alias("content"))
    return single.unionByName(listed)


def chat_to_messages_api(messages: DataFrame, id_col: str) -> DataFrame:
    """Flat messages as payloads with a system prompt of their own (one JSON for each id)."""
    rows = messages.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("msg_idx", "role", "content"))).alias("m"))
    system = F.transform(F.filter("m", lambda m: m["role"] == "system"), lambda m: F.struct(F.lit("text").alias("type"), m["content"].alias("text")))
    rest = F.transform(F.filter("m", lambda m: m["role"] != "system"), lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content")))
    return rows.select(id_col, F.to_json(F.struct(system.alias("system"), rest.alias("messages"))).alias("payload"))


def tool_calls(df: DataFrame, json_col: str, id_cols: list[str]) -> DataFrame:
    """Tool calls of three vendor shapes as ``call_idx, name, arguments``."""
    c = df.select(*id_cols, F.posexplode(F.from_json(json_col, TOOL_CALLS)).alias("call_idx", "c"))
    return c.select(*id_cols, "call_idx", F.coalesce("c.function.name", "c.name", F.lit("")).alias("name"), F.coalesce("c.function.arguments", "c.arguments", "c.input", F.lit("{}")).alias("arguments"))


def tool_text(calls: DataFrame, id_cols: list[str]) -> DataFrame:
    """Name and arguments of all calls of a row as one text, in order."""
    held = calls.groupBy(*id_cols).agg(F.sort_array(F.collect_list(F.struct("call_idx", "name", "arguments"))).alias("c"))
    return held.select(*id_cols, F.array_join(F.transform("c", lambda c: F.concat_ws(" ", c["name"], c["arguments"])), " ").alias("tool_text"))


def context_items(df: DataFrame, id_col: str, json_col: str, keys: list[str]) -> DataFrame:
    """Items of a payload's context keys as ``item_id, text``; items without id are named by place."""
    out = None
    for key in keys:
        items = F.from_json(F.get_json_object(json_col, f"$.{key}"), "array<struct<id:string,text:string,content:string>>")
        rows = df.select(id_col, F.posexplode(items).alias("i", "x")).select(id_col, F.coalesce("x.id", F.concat(F.lit(f"{key}["), F.col("i").cast("string"), F.lit("]"))).alias("item_id"), F.coalesce("x.text", "x.content", F.lit("")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_leaves(df: DataFrame, id_col: str, json_col: str, depth: int = 6) -> DataFrame:
    """All text leaves of a JSON column as ``path, text``; a container at the last of ``depth`` levels is one leaf with its JSON."""
    level = df.select(id_col, F.lit("$").alias("path"), F.col(json_col).alias("v"), F.lit(True).alias("open")).where(F.col("v").isNotNull())
    for _ in range(depth - 1):
        # one chain of explodes: a leaf is its own child; a text that only looks like a container is a leaf
        level = level.withColumn("kind", F.when(F.col("open") & F.try_parse_json("v").isNotNull(), F.substring(F.ltrim("v"), 1, 1)).otherwise(F.lit("")))
        objects = F.transform(F.map_entries(F.from_json("v", "map<string,string>")), lambda e: F.struct(F.concat("path", F.lit("."), e["key"]).alias("path"), e["value"].alias("v"), F.lit(True).alias("open")))
        arrays = F.transform(F.from_json("v", "array<string>"), lambda x, k: F.struct(F.concat("path", F.lit("["), k.cast("string"), F.lit("]")).alias("path"), x.alias("v"), F.lit(True).alias("open")))
        leaf = F.array(F.struct("path", "v", F.lit(False).alias("open")))
        children = F.when(F.col("kind") == "{", objects).when(F.col("kind") == "[", arrays).otherwise(leaf)
        level = level.select(id_col, F.explode_outer(children).alias("n")).select(id_col, "n.*").where(F.col("v").isNotNull())
    return level.select(id_col, "path", F.col("v").alias("text"))


def event_delta(event: Column) -> Column:
    """Text of one stream event of three vendor shapes."""
    return F.coalesce(F.get_json_object(event, "$.choices[0].delta.content"), F.when(F.get_json_object(event, "$.type") == "response.output_text.delta", F.get_json_object(event, "$.delta")), F.get_json_object(event, "$.delta.text"), F.lit(""))


def frames(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Frames between blank lines, line ends unified, as ``seq, frame``."""
    parts = F.filter(F.split(F.regexp_replace(body_col, "\r\n?", "\n"), "\n\n", -1), lambda f: F.trim(f) != "")
    return df.select(id_col, F.posexplode(parts).alias("seq", "frame"))
