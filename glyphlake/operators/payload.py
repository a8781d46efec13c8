"""Chat payloads as columns: last user message, images, replies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import first_of


def last_user(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The last message of role user in each conversation."""
    return first_of(messages.where(F.col(role) == "user"), [conversation], [F.desc(turn)])


def image_bytes(value: Column) -> Column:
    """Bytes of a base64 string or data URL; null for empty, http(s) and data URLs that aren't base64."""
    body = F.when(value.startswith("data:"), F.when(F.substring_index(value, ",", 1).contains(";base64"), F.regexp_replace(value, "^[^,]*,", ""))).otherwise(value)
    fine = value.isNotNull() & (value != "") & ~value.startswith("http://") & ~value.startswith("https://")
    return F.when(fine, F.try_to_binary(body, F.lit("base64")))


PARTS = "array<struct<type:string,text:string,image_url:string>>"


def image_urls(content: Column) -> Column:
    """URLs of a message's content parts of type image_url; the url is a string or an object with one."""
    parts = F.filter(F.from_json(content, PARTS), lambda p: p["type"] == "image_url")
    return F.transform(parts, lambda p: F.coalesce(F.get_json_object(p["image_url"], "$.url"), p["image_url"]))


def openai_reply(ident: Column, text: Column, model: str) -> Column:
    return F.to_json(F.struct(ident.alias("id"), F.lit("chat.completion").alias("object"), F.lit(model).alias("model"), F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")))


def sse(rows: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """Server-sent events of each key: a `data:` row for each row, then [DONE]."""
    events = rows.select(*keys, F.col(order).alias("n"), F.concat(F.lit("data: "), data, F.lit("\n\n")).alias("event"))
    ends = rows.groupBy(*keys).agg((F.max(order) + 1).alias("n")).withColumn("event", F.lit("data: [DONE]\n\n"))
    return events.unionByName(ends)


def event_stream(text: Column, model: str) -> Column:
    """A reply as the whole stream of server-sent events: the text, the end, [DONE]; null is said as empty."""
    head = '{"model":' + json.dumps(model, ensure_ascii=False) + ',"object":"chat.completion.chunk","choices":[{"index":0,"delta":'
    said = F.to_json(F.struct(F.lit("assistant").alias("role"), F.coalesce(text, F.lit("")).alias("content")))
    piece = lambda delta, why: F.concat(F.lit(f"data: {head}"), delta, F.lit(f',"finish_reason":{why}}}]}}\n\n'))
    return F.concat(piece(said, "null"), piece(F.lit("{}"), '"stop"'), F.lit("data: [DONE]\n\n"))


def ollama_reply(text: Column, model: str) -> Column:
    """An empty request is answered as a load."""
    return F.to_json(F.struct(F.lit(model).alias("model"), F.coalesce(text, F.lit("")).alias("response"), F.lit(True).alias("done"), F.when(F.coalesce(text, F.lit("")) == "", "load").otherwise("stop").alias("done_reason")))


#: The largest body that is read, and the first bytes of images.
BODY = 64 << 20
MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D"}


def image_kind(body: Column) -> Column:
    """png, jpeg, gif or bmp by the first bytes; null for anything else."""
    head = F.hex(F.substring(body, 1, 4))
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def routed(requests: DataFrame, model: str, method: str = "method", path: str = "path", text: str = "text", size: str = "bytes") -> DataFrame:
    """requests -> with status and body: static answers to GET, replies to POST by path, 404 for other paths, 413 for bodies
    over BODY and 400 for empty ones, each error in its path's shape."""
    m, at = F.col(method), F.col(path)
    openai = at.startswith("/v1/")
    models = F.to_json(F.struct(F.lit("list").alias("object"), F.array(F.struct(F.lit(model).alias("id"))).alias("data")))
    tags = F.to_json(F.struct(F.array(F.struct(F.lit(model).alias("name"))).alias("models")))
    get = F.when(at == "/v1/models", models).when(at == "/api/tags", tags).when(at == "/api/version", F.lit('{"version":"1"}')).when(at == "/", F.lit("ok"))
    known = at.isin("/read", "/v1/chat/completions", "/api/chat", "/api/generate", "/api/show")
    empty = (F.coalesce(F.col(text), F.lit("")) == "") & ~at.isin("/api/generate", "/api/show")
    status = F.when(m == "GET", F.when(get.isNotNull(), 200).otherwise(404)).when((m != "POST") | ~known, 404).when(F.col(size) > BODY, 413).when(empty, 400).otherwise(200)
    said = F.when(status == 404, "no such path").when(status == 413, "body too large").otherwise("no image")
    error = F.when(openai, F.to_json(F.struct(F.struct(said.alias("message"), F.lit("invalid_request_error").alias("type")).alias("error")))).otherwise(F.to_json(F.struct(said.alias("error"))))
    reply = F.when(openai, openai_reply(at, F.col(text), model)).when(at == "/read", F.to_json(F.struct(F.col(text).alias("text")))).otherwise(ollama_reply(F.col(text), model))
    return requests.withColumn("status", status).withColumn("body", F.when(status != 200, error).when(m == "GET", get).otherwise(reply))


def ndjson(replies: DataFrame, keys: list[str], model: str, text: str = "text", why: str = "stop") -> DataFrame:
    """replies(keys..., text) -> keys, n, line: a streamed reply as lines of JSON: the text unless it is empty, then the end."""
    say = lambda words: F.struct(F.lit("assistant").alias("role"), words.alias("content"))
    words = F.coalesce(F.col(text), F.lit(""))
    piece = F.to_json(F.struct(F.lit(model).alias("model"), say(words).alias("message"), F.lit(False).alias("done")))
    last = F.to_json(F.struct(F.lit(model).alias("model"), say(F.lit("")).alias("message"), F.lit(True).alias("done"), F.lit(why).alias("done_reason")))
    lines = F.when(words == "", F.array(last)).otherwise(F.array(piece, last))
    return replies.select(*keys, F.posexplode(lines).alias("n", "line")).withColumn("line", F.concat("line", F.lit("\n")))
