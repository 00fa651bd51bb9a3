"""Column functions as temporary SQL functions of the same names, and table functions.

Bodies are SQL, so Spark inlines them into the plan of the statement that calls them: filters are pushed below them, and no
Python runs.  ``register`` adds them to a session; they belong to that session and hide nothing that is stored.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "clean": ("value string", "string", r"trim(regexp_replace(coalesce(value, ''), r'\s+', ' '))"),
    "first_nonempty": ("first string, second string default null, third string default null", "string",
                       "coalesce(nullif(clean(first), ''), nullif(clean(second), ''), nullif(clean(third), ''), '')"),
    "to_millis": ("value string", "bigint", """
        case when trim(value) = '' then null
             when try_cast(trim(value) as double) is not null and not isnan(try_cast(trim(value) as double))
             then cast(floor(if(try_cast(trim(value) as double) < 1e12, try_cast(trim(value) as double) * 1000, try_cast(trim(value) as double))) as bigint)
             else unix_millis(try_to_timestamp(trim(value))) end"""),
    "iso_time": ("millis bigint", "string", "date_format(timestamp_millis(millis), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"),
    "total_tokens": ("explicit bigint, tokens_in bigint, tokens_out bigint", "bigint",
                     "coalesce(explicit, if(coalesce(tokens_in, tokens_out) is null, null, coalesce(tokens_in, 0) + coalesce(tokens_out, 0)))"),
    "agent_role": ("role string", "string", """
        case when lower(clean(role)) in ('user', 'human') then 'user'
             when lower(clean(role)) in ('assistant', 'ai', 'model', '') then 'assistant'
             else lower(clean(role)) end"""),
    "model_label": ("name string, model_id string, model_type string default null", "string",
                    "if(name <> '' and model_id <> '' and name <> model_id, concat(name, ' (', model_id, ')'), first_nonempty(name, model_id, model_type))"),
    "title_of": ("first string, second string default null, third string default null", "string", """
        case when first_nonempty(first, second, third) = '' then 'Untitled conversation'
             when length(first_nonempty(first, second, third)) <= 120 then first_nonempty(first, second, third)
             else concat(trim(substring(first_nonempty(first, second, third), 1, 120)), '...') end"""),
    "short_preview": ("value string, fallback string default 'No preview available'", "string", """
        if(length(coalesce(value, fallback)) > 180, concat(substring(coalesce(value, fallback), 1, 177), '...'), coalesce(value, fallback))"""),
    "word_count": ("value string", "bigint", r"cast(size(filter(split(coalesce(value, ''), r'\s+'), word -> word <> '')) as bigint)"),
    "natural_key": ("value string", "string", """
        array_join(transform(regexp_extract_all(lower(coalesce(value, '')), '([0-9]+|[^0-9]+)', 1), part ->
            if(part rlike '^[0-9]', concat(lpad(cast(length(ltrim('0', part)) as string), 10, '0'), ltrim('0', part)), part)), '')"""),
    "base_name": ("path string", "string", "regexp_extract(coalesce(path, ''), '([^/]*)$', 1)"),
    "extension_of": ("path string", "string", r"lower(regexp_extract(base_name(path), r'.(\.[^.]*)$', 1))"),
    "escape_html": ("value string", "string", """
        replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), "'", '&#39;')"""),
}

#: name: (parameters, columns, query)
TABLE_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "token_rows": ("value string", "position int, token string",
                   r"select pos + 1, col from posexplode(regexp_extract_all(lower(coalesce(value, '')), r'([\p{L}\p{N}]+)', 1))"),
    "path_rows": ("path string", "depth int, step string", "select pos + 1, col from posexplode(filter(split(coalesce(path, ''), '/'), step -> step <> ''))"),
}


def register(spark: SparkSession) -> SparkSession:
    """The session with all functions; calling it again changes nothing."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    for name, (parameters, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table({columns}) return {body}")
    return spark
