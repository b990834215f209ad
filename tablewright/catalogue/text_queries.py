"""Tagging of commands, statements and questions."""

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.registry import query
from tablewright.functions import lexicon, tagging


def case_of(expr: str, rules: dict[str, list[str]], default: str) -> str:
    arms = [
        f"WHEN {' OR '.join(f'contains({expr}, {quote(w)})' for w in words)} THEN {quote(label)}"
        for label, words in rules.items()
    ]
    return f"CASE {' '.join(arms)} ELSE {default} END"


def quote(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


@query(
    "t01_command_intent",
    views.with_views(
        views.COMMANDS_SQL,
        then=f"SELECT conv_id, turn, {case_of('lower(command)', lexicon.INTENT_WORDS, quote('help'))} AS intent FROM commands",
    ),
)
def command_intent(spark, sf_dir):
    return views.commands(spark, sf_dir).select(
        "conv_id", "turn", tagging.command_intent(F.col("command")).alias("intent")
    )


_BASIC = " ".join(
    f"WHEN regexp_matches(upper(statement), {quote(p)}) THEN {quote(why)}" for p, why in lexicon.STATEMENT_RULES
)
_STRICT = " ".join(
    f"WHEN contains(upper(statement), {quote(w)}) THEN {quote(w + ' is not allowed')}" for w in lexicon.STRICT_WORDS
)


@query(
    "t02_statement_screening",
    views.with_views(
        views.STATEMENTS_SQL,
        then=f"""SELECT event_id, basic = 'OK' AS is_safe, basic AS reason, strict = 'OK' AS strict_is_safe, strict AS strict_reason
        FROM (SELECT event_id, CASE {_BASIC} ELSE 'OK' END AS basic, CASE {_STRICT} ELSE 'OK' END AS strict FROM statements) t""",
    ),
)
def statement_screening(spark, sf_dir):
    s = F.col("statement")
    verdicts = views.statements(spark, sf_dir).select(
        "event_id", tagging.statement_verdict(s).alias("b"), tagging.statement_verdict(s, strict=True).alias("s")
    )
    return verdicts.select(
        "event_id", "b.is_safe", "b.reason", F.col("s.is_safe").alias("strict_is_safe"), F.col("s.reason").alias("strict_reason")
    )


@query(
    "t03_requested_limit",
    views.with_views(
        views.COMMANDS_SQL,
        then="""SELECT conv_id, turn, COALESCE(
          TRY_CAST(NULLIF(regexp_extract(lower(command), '(?:top|first|limit)\\s+([0-9]+)', 1), '') AS INTEGER),
          CASE WHEN contains(lower(command), 'top one') OR contains(lower(command), 'the best') THEN 1
               WHEN contains(lower(command), 'top three') THEN 3 WHEN contains(lower(command), 'top five') THEN 5
               WHEN contains(lower(command), 'top ten') THEN 10 END, 10) AS wanted FROM commands""",
    ),
)
def requested_limit(spark, sf_dir):
    return views.commands(spark, sf_dir).select(
        "conv_id", "turn", tagging.requested_limit(F.col("command")).alias("wanted")
    )


@query(
    "t04_question_pattern",
    views.with_views(
        views.COMMANDS_SQL,
        then=f"""SELECT pattern, CAST(COUNT(*) AS BIGINT) AS questions FROM (
          SELECT {case_of('lower(command)', lexicon.PATTERN_WORDS, 'NULL')} AS pattern FROM commands) t GROUP BY pattern""",
    ),
)
def question_pattern(spark, sf_dir):
    tagged = views.commands(spark, sf_dir).select(tagging.question_pattern(F.col("command")).alias("pattern"))
    return tagged.groupBy("pattern").agg(F.count(F.lit(1)).alias("questions"))
