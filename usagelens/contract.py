"""The request table: one declaration of its columns, types, sources and checks.

Ingest, validation and the field audit all read this one list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from usagelens import settings

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "instant": T.TimestampType(),
    "wall_clock": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    read: str = "derived"
    sources: tuple[str, ...] = ()
    required: bool = False
    check: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return _TYPES[self.type]


def _text(name: str, *sources: str, required: bool = False, check: str | None = None) -> Field:
    return Field(name, "string", "text", sources, required, check)


def _listed(name: str, *sources: str) -> Field:
    return Field(name, "string", "listed", sources)


def _int(name: str, *sources: str, required: bool = False, read: str = "int") -> Field:
    return Field(name, "long", read, sources, required, "non_negative")


def _bool(name: str, *sources: str, required: bool = False) -> Field:
    return Field(name, "boolean", "bool", sources, required)


def _detail(name: str, side: str, nested: str | None = None) -> Field:
    """A token counter kept flat, or nested under the input or output details."""
    return _int(
        name,
        f"usage_details.{name}",
        f"usage_details.{side}_tokens_details.{nested or name}",
    )


# The columns of the request table and the JSON locations they come from.
REQUEST_FIELDS: tuple[Field, ...] = (
    Field("source_path", "string", required=True),
    Field("source_file", "string", required=True),
    _text("source_file_original", "source_file", required=True),
    _text("request_id", "request.request_id", required=True, check="unique"),
    Field("ts_utc", "instant", "time", ("time.received_at",), required=True),
    Field("ts_local", "wall_clock", required=True),
    Field("date_local", "string", required=True),
    Field("hour_local", "long", required=True, check="between 0 and 23"),
    Field("weekday_local", "long", required=True, check="between 0 and 6"),
    Field("ts_created_utc", "instant", "time", ("time.created_at",)),
    Field("ts_created_local", "wall_clock"),
    Field("log_lag_ms", "long"),
    _text("username", "identity.username", required=True),
    _text("user_account", "identity.user_account", required=True),
    _text("endpoint", "request.endpoint", required=True),
    _text("method", "request.method", required=True),
    Field("status_code", "long", "int", ("request.status_code",), True, "between 100 and 599"),
    _bool("stream", "request.stream", required=True),
    _int("latency_ms", "request.latency_ms", required=True),
    _text("provider", "model.provider", required=True),
    _text("worker", "model.worker", required=True),
    _text("model_requested", "model.model_requested"),
    _text("model_returned", "model.model_returned"),
    Field("model_family", "string"),
    _text("response_model", "response_summary.model"),
    _text("originator", "client.originator", required=True),
    _text("user_agent", "client.user_agent", required=True),
    _text("host", "client.host", required=True),
    _text("remote_addr", "client.remote_addr", required=True),
    Field("client_type", "string", required=True, check="client_type"),
    _text("thread_id", "conversation.thread_id", check="not_blank"),
    _text("session_id", "conversation.session_id", check="not_blank"),
    _text("turn_id", "conversation.turn_id", check="not_blank"),
    _text("parent_thread_id", "conversation.parent_thread_id", check="not_blank"),
    _text("conversation_key", "conversation.conversation_key", required=True),
    _int("prompt_tokens", "usage.prompt_tokens", required=True),
    _int("completion_tokens", "usage.completion_tokens", required=True),
    _int("total_tokens", "usage.total_tokens", required=True),
    _detail("cached_tokens", "input"),
    _detail("cache_write_tokens", "input"),
    _detail("reasoning_tokens", "output"),
    _detail("input_text_tokens", "input", "text_tokens"),
    _detail("input_audio_tokens", "input", "audio_tokens"),
    _detail("input_image_tokens", "input", "image_tokens"),
    _detail("output_text_tokens", "output", "text_tokens"),
    _detail("output_audio_tokens", "output", "audio_tokens"),
    _detail("output_image_tokens", "output", "image_tokens"),
    _detail("accepted_prediction_tokens", "output"),
    _detail("rejected_prediction_tokens", "output"),
    Field("usage_missing", "boolean", required=True),
    _text("tool_choice", "request_options.tool_choice"),
    _bool("parallel_tool_calls", "request_options.parallel_tool_calls"),
    _bool("store", "request_options.store"),
    _text("prompt_cache_key", "request_options.prompt_cache_key"),
    Field("temperature", "double", "float", ("request_options.temperature",), False, "non_negative"),
    _int("tool_count", "request_options.tool_count", read="count"),
    _listed("tool_types", "request_options.tool_types"),
    _int("instructions_length", "request_options.instructions_length"),
    _text("reasoning_effort", "request_options.reasoning.effort"),
    _text("reasoning_summary", "request_options.reasoning.summary"),
    _text("reasoning_context", "request_options.reasoning.context"),
    _text("text_verbosity", "request_options.text.verbosity"),
    _text("text_format_name", "request_options.text.format.name", "request_options.text.format.type"),
    _listed("client_metadata_keys", "request_options.client_metadata_keys"),
    _int("max_completion_tokens", "request_options.max_completion_tokens"),
    _int("max_tokens", "request_options.max_tokens"),
    _listed("include_options", "request_options.include"),
    _bool("request_stream_option", "request_options.stream"),
    _int("sse_bytes", "response_summary.meta.bytes"),
    _text("content_type", "response_summary.meta.content_type"),
    _bool("truncated", "response_summary.meta.truncated"),
    _listed("finish_reasons", "response_summary.finish_reasons"),
    Field("error_type", "string", "error_text", ("response_summary.error.type", "response_summary.error")),
    _text("error_code", "response_summary.error.code"),
    _text("error_param", "response_summary.error.param"),
    _text("image_model", "image_request.model"),
    _int("image_n", "image_request.n"),
    _text("image_quality", "image_request.quality"),
    _text("image_size", "image_request.size"),
    _int("prompt_len", "content.prompt", required=True, read="length"),
    _int("assistant_response_len", "content.assistant_response", required=True, read="length"),
    _int("memory_len", "content.memory", required=True, read="length"),
    _text("messages_format", "messages_summary.format", required=True),
    _int("message_count", "messages_summary.message_count", required=True),
    _int("user_message_count", "messages_summary.user_message_count", required=True),
    _int("assistant_message_count", "messages_summary.assistant_message_count", required=True),
    _text("noise_category", "noise_category", required=True),
    Field("pipeline_version", "string", required=True),
    Field("ingested_at", "instant", required=True),
)

# Named checks as predicates on a column; any other check of a field is a predicate already.
PREDICATES = {
    "non_negative": ">= 0",
    "not_blank": "<> ''",
    "client_type": "in ({})".format(", ".join(f"'{c}'" for c in settings.KNOWN_CLIENT_TYPES)),
}

BLANK_AS_NULL = tuple(f.name for f in REQUEST_FIELDS if f.check == "not_blank")

REQUEST_SCHEMA = T.StructType([T.StructField(f.name, f.spark_type) for f in REQUEST_FIELDS])

PARTITION_COLUMN = "date_local"

# Column natures: a cumulative counter repeats the whole history in every request, so only its
# maximum means anything; a constant should not vary inside a turn; an additive one may be summed.
CUMULATIVE = ("message_count", "user_message_count", "assistant_message_count")
CONSTANT = (
    "reasoning_effort",
    "tool_count",
    "tool_types",
    "instructions_length",
    "text_verbosity",
    "prompt_cache_key",
    "model_requested",
)
ADDITIVE = ("prompt_tokens", "completion_tokens", "cached_tokens", "latency_ms", "sse_bytes")


def source_map(fields: tuple[Field, ...] = REQUEST_FIELDS) -> list[tuple[str, str]]:
    """(column, JSON path) of every column that is read from the record."""
    return [(f.name, path) for f in fields for path in f.sources]
