"""Stand-in corpora from hash expressions: the same texts from Spark and from any SQL with md5, at every parallelism."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sampling import SEED, ranked

NOUNS = tuple("walrus teapot glacier trumpet cabbage ladder comet sandal beetle mirror parcel tundra biscuit rudder pigeon attic".split())
VERBS = tuple("whistles juggles polishes forgets invents paints swallows dodges wraps hums".split())
ADJECTIVES = tuple("striped sleepy enormous crunchy purple wobbly sour noisy velvet foggy polite".split())
LINKS = tuple("since though after once wherever as".split())
SMALL = tuple("this that these those some any his her its our for into".split())
DULL_NOUNS, DULL_VERBS, DULL_ADJECTIVES = (tuple(x.split()) for x in ("report topic product method service", "supports presents covers includes explains", "general common basic regular typical"))
#: Phrases of the probe that open a collapsed sentence.
OPENERS = ("it is important to note", "in conclusion", "furthermore", "moreover", "additionally", "overall", "it is worth noting", "in summary")
#: Percent limits of sentence lengths (with least and number of lengths) and of word classes, and of typos.
LENGTHS = ((35, 3, 5), (75, 8, 11), (100, 19, 12))
CLASSES = ((30, NOUNS), (50, VERBS), (68, ADJECTIVES), (80, LINKS), (100, SMALL))
TYPOS = 8


@dataclass
class Dialect:
    """What differs between two kinds of SQL."""

    digits: Callable[[str], str]
    array: Callable[[tuple[str, ...]], str]
    item: Callable[[str, str], str]
    each: Callable[[str, str, str], str]
    let: Callable[[str, str, str], str]
    join: Callable[[str, str], str]
    last: Callable[[str, str, str], str]


SPARK = Dialect(
    digits=lambda key: f"cast(conv(substring(md5({key}), 1, 7), 16, 10) as bigint)",
    array=lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")",
    item=lambda a, i: f"element_at({a}, cast(1 + {i} as int))",
    each=lambda n, x, body: f"transform(sequence(0L, {n} - 1L), {x} -> {body})",
    let=lambda value, x, body: f"element_at(transform(array({value}), {x} -> {body}), 1)",
    join=lambda a, mark: f"array_join({a}, '{mark}')",
    last=lambda n, x, test: f"array_max(filter(sequence(0L, {n}), {x} -> {test}))",
)
DUCKDB = Dialect(
    digits=lambda key: f"('0x' || substr(md5({key}), 1, 7))::bigint",
    array=lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]",
    item=lambda a, i: f"{a}[1 + {i}]",
    each=lambda n, x, body: f"list_transform(range(0, {n}), lambda {x}: {body})",
    let=lambda value, x, body: f"list_transform([{value}], lambda {x}: {body})[1]",
    join=lambda a, mark: f"array_to_string({a}, '{mark}')",
    last=lambda n, x, test: f"list_max(list_filter(range(0, {n} + 1), lambda {x}: {test}))",
)


def _draw(d: Dialect, n: int | str, *key: str) -> str:
    """A number below n that hangs on `k`, the text's key, and on what is drawn."""
    return f"({d.digits(' || '.join(('k', *(f"':' || {x}" for x in key))))} % {n})"


def _one_of(d: Dialect, words: tuple[str, ...], *key: str) -> str:
    return d.item(d.array(words), _draw(d, len(words), *key))


def human_sql(d: Dialect) -> str:
    """Four to nine sentences of mixed length and vocabulary, now and then with a doubled letter."""
    kind = _draw(d, 100, "s", "w", "'c'")
    word = "case " + " ".join(f"when {kind} < {upto} then {_one_of(d, words, 's', 'w', chr(39) + 'p' + chr(39))}" for upto, words in CLASSES) + " end"
    size = _draw(d, 100, "s", "'l'")
    length = "case " + " ".join(f"when {size} < {upto} then {least} + {_draw(d, n, 's', chr(39) + 'm' + chr(39))}" for upto, least, n in LENGTHS) + " end"
    at = _draw(d, "length(z)", "s", "'a'")
    typo = f"case when {_draw(d, 100, 's', chr(39) + 't' + chr(39))} < {TYPOS} and length(z) > 5 then substr(z, 1, cast({at} + 1 as int)) || substr(z, cast({at} + 1 as int)) else z end"
    sentence = d.let(d.join(d.each(f"({length})", "w", word), " "), "z", d.let(typo, "y", "upper(substr(y, 1, 1)) || substr(y, 2)"))
    return f"{d.join(d.each(f'(4 + {_draw(d, 6, chr(39) + 'n' + chr(39))})', 's', sentence), '. ')} || '.'"


def collapsed_sql(d: Dialect) -> str:
    """Four to seven templated sentences; later generations `g` have fewer words and repeat the sentence before more often."""
    few, again = "greatest(2, 5 - g)", "least(85, 35 + 15 * g)"
    pick = lambda words, what: d.item(d.array(words), _draw(d, few, "j", f"'{what}'"))
    core = f"'our ' || {pick(DULL_ADJECTIVES, 'a')} || ' ' || {pick(DULL_NOUNS, 'n')} || ' ' || {pick(DULL_VERBS, 'v')} || ' every ' || {pick(DULL_NOUNS, 'o')}"
    # The last sentence up to this one that does not repeat.
    own = d.last("s", "q", f"q = 0 or {_draw(d, 100, 'q', chr(39) + 'r' + chr(39))} >= {again}")
    sentence = f"{_one_of(d, OPENERS, 's', chr(39) + 'u' + chr(39))} || ' ' || {d.let(own, 'j', core)}"
    return f"{d.join(d.each(f'(4 + {_draw(d, 4, chr(39) + 'n' + chr(39))})', 's', sentence), '. ')} || '.'"


#: (part, number of texts, contamination, generation) of a corpus.
Spec = tuple[float, int, float, int]


def make_datasets(spark: SparkSession, specs: list[Spec], seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text, label, part) for specs, all made in one plan.

    Of each part, round(n * contamination) texts (half to even) are collapsed and the others human-like, and the part is
    then shuffled: the ids follow a seeded order.
    """
    rows = [(p, n, round(n * c), g, sum(x[1] for x in specs[:j])) for j, (p, n, c, g) in enumerate(specs)]
    d = spark.createDataFrame(rows, "part double, n long, synthetic long, g int, base long").where("n > 0")
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")).withColumn("k", F.concat_ws(":", F.lit(str(seed)), F.col("part").cast("string"), "g", "nth"))
    d = ranked(d, "r", F.col("k"), seed, "part")
    text = f"case when nth < synthetic then {collapsed_sql(SPARK)} else {human_sql(SPARK)} end"
    return d.select((F.col("base") + F.col("r") - 1).alias("doc_id"), F.expr(text).alias("text"), F.when(F.col("nth") < F.col("synthetic"), "synthetic").otherwise("human").alias("label"), "part")


def datasets_sql(specs: list[Spec], seed: int = SEED) -> str:
    """The rows of `make_datasets` as a query for DuckDB."""
    rows = ", ".join(f"({p!r}::double, {n}, {round(n * c)}, {g}, {sum(x[1] for x in specs[:j])})" for j, (p, n, c, g) in enumerate(specs))
    return f"""select base + row_number() over (partition by part order by md5('{seed}:' || k), k) - 1 as doc_id, case when nth < synthetic then {collapsed_sql(DUCKDB)} else {human_sql(DUCKDB)} end as text, case when nth < synthetic then 'synthetic' else 'human' end as label, part
 from (select *, '{seed}:' || part || ':' || g || ':' || nth as k from (select *, unnest(range(n)) as nth from (values {rows}) v(part, n, synthetic, g, base)))"""


def make_dataset(spark: SparkSession, n: int, contamination: float, generation: int = 1, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text, label) of one part."""
    return make_datasets(spark, [(0.0, n, contamination, generation)], seed).drop("part")


def generation_specs(generations: int = 4, n: int = 60) -> list[Spec]:
    """Each generation more contaminated and more collapsed."""
    return [(float(g), n, min(1.0, 0.25 * g), g) for g in range(1, generations + 1)]


assert set(OPENERS) <= set(T.FILLER_PHRASES)
