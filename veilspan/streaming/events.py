"""What a stream restorer does with each server-sent event of two protocols, as a projection.

``plan`` adds to parsed events: action (verbatim, delta or restore), channel, fragment, is_json, the channels
to flush before the event, and whether every channel is flushed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event names of the second protocol.
DELTAS = tuple(f"response.{n}.delta" for n in ("output_text", "function_call_arguments", "custom_tool_call_input", "mcp_call_arguments", "refusal", "audio.transcript", "code_interpreter_call_code"))
JSON_DELTAS = ("response.function_call_arguments.delta", "response.mcp_call_arguments.delta")
VERBATIM = ("response.audio.delta", "response.audio.done", "response.image_generation_call.partial_image")
REASONING = "response.reasoning"


def plan(events: DataFrame, data_col: str, protocol_col: str) -> DataFrame:
    data = F.col(data_col)
    at = lambda path: F.get_json_object(data, path)
    kind, messages = F.coalesce(at("$.type"), F.lit("")), F.col(protocol_col) == "messages"
    index, delta = F.coalesce(at("$.index"), F.lit("0")), at("$.delta.type")
    item = F.coalesce(at("$.item_id"), at("$.output_index"), F.lit("0"))
    block = messages & (kind == "content_block_delta")
    text, partial = block & F.coalesce(delta == "text_delta", F.lit(False)), block & F.coalesce(delta == "input_json_delta", F.lit(False))
    streamed = ~messages & kind.isin(*DELTAS)
    kept = (block & F.coalesce(delta.isin("thinking_delta", "signature_delta"), F.lit(False))) | (~messages & (kind.startswith(REASONING) | kind.isin(*VERBATIM)))
    done = ~messages & kind.isin(*[d.removesuffix("delta") + "done" for d in DELTAS])
    stop = messages & (kind == "content_block_stop")
    none = F.array().cast("array<string>")
    name = lambda *p: F.concat_ws(":", *p)
    return events.select(
        "*",
        F.when(text | partial | streamed, "delta").when(kept, "verbatim").otherwise("restore").alias("action"),
        F.when(text, name(F.lit("text"), index)).when(partial, name(F.lit("json"), index)).when(streamed, name(kind, item)).alias("channel"),
        F.when(text, at("$.delta.text")).when(partial, at("$.delta.partial_json")).when(streamed, at("$.delta")).alias("fragment"),
        (partial | (~messages & kind.isin(*JSON_DELTAS))).alias("is_json"),
        F.when(stop, F.array(name(F.lit("text"), index), name(F.lit("json"), index))).when(done, F.array(name(F.regexp_replace(kind, "done$", "delta"), item))).otherwise(none).alias("flush"),
        ((messages & (kind == "message_stop")) | (~messages & (kind == "response.completed"))).alias("flush_all"),
    )


def flush_event(channel: Column, rest: Column) -> Column:
    """The event that carries a channel's held text, as JSON."""
    kind, where = F.substring_index(channel, ":", 1), F.substring_index(channel, ":", -1)
    block = F.to_json(F.struct(
        F.lit("content_block_delta").alias("type"), where.cast("int").alias("index"),
        F.struct(F.when(kind == "json", "input_json_delta").otherwise("text_delta").alias("type"), F.when(kind != "json", rest).alias("text"), F.when(kind == "json", rest).alias("partial_json")).alias("delta"),
    ))
    item = F.to_json(F.struct(kind.alias("type"), rest.alias("delta"), F.when(~where.rlike("^[0-9]+$"), where).alias("item_id"), F.when(where.rlike("^[0-9]+$"), where.try_cast("int")).alias("output_index")))
    return F.when(kind.isin("text", "json"), block).otherwise(item)
