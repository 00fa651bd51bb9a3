"""Statements in plain SQL over the registered SQL functions."""

from threadlake.functions import sql
from threadlake.plans.registry import Tables, query


@query("U_sql_functions", """
    select id, case role when 'human' then 'user' else role end as role,
           strftime(make_timestamp(created_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as at,
           created_ms as again,
           case when model is null then role else concat(model, ' (', role, ')') end as label,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as words,
           md5(case when length(coalesce(text, 'nothing said')) > 180 then concat(substring(text, 1, 177), '...') else coalesce(text, 'nothing said') end) as preview,
           '.json' as extension,
           coalesce(length(text), 0) + length(id) as tokens
    from {msgs}""")
def sql_functions(t: Tables):
    sql.register(t.spark)
    return t.sql("""
        select id, agent_role(role) as role, iso_time(created_ms) as at, to_millis(iso_time(created_ms)) as again,
               model_label(model, role) as label, word_count(text) as words, md5(short_preview(text, 'nothing said')) as preview,
               extension_of(concat('messages/', id, '.JSON')) as extension, total_tokens(null, length(text), length(id)) as tokens
        from {msgs}""")


@query("U_sql_table_function", r"""
    with found as (
        select lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '([\p{{L}}\p{{N}}]+)', 1)) as token,
               unnest(generate_series(1, len(regexp_extract_all(lower(coalesce(text, '')), '([\p{{L}}\p{{N}}]+)', 1)))) as position
        from {documents}
    )
    select lang, token, count(*) as n, min(position) as earliest from found group by lang, token""")
def sql_table_function(t: Tables):
    sql.register(t.spark)
    return t.sql("""
        select lang, token, count(*) as n, min(position) as earliest
        from {documents}, lateral token_rows(text)
        group by lang, token""")
