"""Code rules over source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import oracle
from docloom.catalog.registered import query
from docloom.catalog.views import CODE_LANGUAGE, CODE_SQL, code_files
from docloom.functions.language import language_of, outline_language
from docloom.operators.extraction import extract
from docloom.operators.outline import NAMED_LANGUAGES, OUTLINE_RULES, extract_outline
from docloom.operators.rules import CODE_RULES, Rule

SOURCE = f"SELECT *, {CODE_LANGUAGE} AS language FROM ({CODE_SQL})"
SHOWN = ["rule_id", "match", "name", "entity_type", "description", "position", "context", "relevance"]


def files(spark, folder):
    return code_files(spark, folder).withColumn("language", language_of(F.col("path"), F.col("text")))


def _register(name: str, rules: tuple[Rule, ...]) -> None:
    @query(name, oracle.code_sql(SOURCE, rules))
    def run(spark, folder):
        return extract(files(spark, folder), ["p_partkey"], "text", rules, "language").select("p_partkey", *SHOWN)


for _number, _rule in enumerate(CODE_RULES, 1):
    _register(f"c{_number:02d}_{_rule.rule_id}", (_rule,))
_register("c_all_rules", CODE_RULES)


# ------------------------------------------------------------------ outlines
_OUTLINED = f"SELECT * REPLACE (CASE WHEN language = 'bash' THEN 'shell' ELSE language END AS language) FROM ({SOURCE})"


def _register_outline(name: str, prefix: str) -> None:
    rules = tuple(r for r in OUTLINE_RULES if r.rule_id.startswith(prefix))

    @query(name, oracle.outline_sql(_OUTLINED, rules, NAMED_LANGUAGES))
    def run(spark, folder):
        rows = code_files(spark, folder).withColumn("language", outline_language(F.col("path")))
        found = extract_outline(rows, ["p_partkey"])
        return found.filter(F.col("rule_id").isin(*[r.rule_id for r in rules])).drop("ordinal")


_register_outline("c35_python_outline", "python_")
_register_outline("c36_script_outline", "script_")
_register_outline("c37_c_outline", "c_")
_register_outline("c38_shell_outline", "shell_")
_register_outline("c39_other_outline", "other_")
