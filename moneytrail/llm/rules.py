"""Quality rules: a table of thresholds compiled into one projection.

A text is measured once (lengths, symbols, stop words, lines, repetitions) and every rule compares one measure, or the ratio of
two, with its limits. Measures and rules are SQL expressions, so a scan with one projection is the whole job: nothing is shuffled.
"""

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.helpers import SPACE, let

#: Words of a window that counts as repeated.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Cut from the end of a word before it is looked up.
ENDS = ".,;:!?"
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to a in is it for was on that by with as be this are or an at from not have he they which "
    "der die das und ist von den mit zu ein eine auf für sich des dem im nicht auch es "
    "le la les de et un une du que qui en dans pour est pas au sur par ce il "
    "el los las y por con una para se del su al lo como más".split()
)


class Rule(NamedTuple):
    """``low`` <= measure / per <= ``high``; a limit of None is none, ``per`` of None is 1.

    A share of few things says little: the rule holds for every text whose ``per`` is below ``least``.
    """

    name: str
    measure: str
    per: str | None
    low: float | None
    high: float | None
    least: int = 1


#: The base: texts that break these fail whatever the others say.
BASE = (
    Rule("few_words", "n_words", None, 10, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.2),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 2, 15),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("words_with_letters", "n_letter_words", "n_words", 0.7, None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None, 30),
    Rule("shouting", "n_shouted_words", "n_words", None, 0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5, 4),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9, 4),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3, 4),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in ``words``.

    Windows are compared by hash first and word by word where hashes agree. Only a text with a repeated hash is sorted.
    """
    none = F.lit(0).cast("long")

    def same(ws, a, b):
        return (a["h"] == b["h"]) & (F.slice(ws, a["i"] + 1, window) == F.slice(ws, b["i"] + 1, window))

    def starts(ws, ordered):
        again = F.filter(ordered, lambda g, k: same(ws, g, F.get(ordered, k - 1)) | same(ws, g, F.get(ordered, k + 1)))
        return F.sort_array(F.transform(again, lambda g: g["i"]))

    def covered(places):
        # a window adds its words up to the start of the next one
        added = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(added, none, lambda total, n: total + n)

    def counted(ws):
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)])
        )
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), let(
            F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda ordered: let(starts(ws, ordered), covered),
        )).otherwise(none))

    return let(words, lambda ws: F.when(F.size(ws) > window, counted(ws)).otherwise(none))


def measures(text: Column) -> Column:
    """Struct of all measures of a text, whole numbers; a null text is measured as an empty one.

    Words are runs of other characters than the six ASCII blanks, lines what line feeds separate. Only lines with a word count.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.translate(line, BLANKS, "") != "")

    def share(ws, test):
        return F.size(F.filter(ws, test))

    def of(ws, ls):
        counts = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.translate(whole, BLANKS, "")),
            "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": repeated_words(ws),
            "n_lines": F.size(ls),
            "n_letter_words": share(ws, lambda w: w.rlike(r"\p{L}")),
            "n_stop_words": share(ws, lambda w: F.lower(F.rtrim(w, F.lit(ENDS))).isin(*STOP_WORDS)),
            "n_shouted_words": share(ws, lambda w: w.endswith("!!")),
            "n_bullet_lines": share(ls, lambda line: line.rlike(r"^[\x20\x09]*[-*•]")),
            "n_ellipsis_lines": share(ls, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])

    return let(words, lambda ws: let(lines, lambda ls: of(ws, ls)))


def broken(rule: Rule, measured) -> Column:
    """Whether a text with the measures ``measured(name)`` breaks a rule. Limits are compared as hundredths, in whole numbers."""
    value = measured(rule.measure) * 100
    per = measured(rule.per) if rule.per else F.lit(1)
    below = F.lit(False) if rule.low is None else value < per * round(100 * rule.low)
    above = F.lit(False) if rule.high is None else value > per * round(100 * rule.high)
    return (per >= rule.least) & (below | above)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``quality``: every measure, base_failed, kept, and the names of the broken rules.

    One output row per input row, repeated ones too; an empty table gives an empty result. A null text is an empty one, which
    fails the base by its number of words. A text of any length is measured whole. A column named quality is replaced.
    """
    measured = docs.withColumn("quality", measures(F.col(text)))

    def of(name):
        return F.col("quality")[name]

    def names(table):
        return F.array_compact(F.array(*[F.when(broken(r, of), F.lit(r.name)) for r in table]))

    def any_of(table):
        return reduce(or_, [broken(r, of) for r in table], F.lit(False))

    failed = any_of(base)
    verdict = F.col("quality").withField("base_failed", failed).withField("kept", ~(failed | any_of(rules)))
    return measured.withColumn("quality", verdict.withField("broken", F.array_join(names([*base, *rules]), ",")))
