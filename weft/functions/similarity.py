"""String similarity of mentions as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which entity is meant.
STOPWORDS = ("the", "a", "an", "of", "project", "team", "new", "our", "system")


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, 1))).otherwise(
        F.array().cast("array<string>")
    )


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; half transpositions count."""
    n, m = F.length(a), F.length(b)
    ca, cb = _chars(a), _chars(b)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2).cast("int") - 1)

    def step(used: Column, i: Column) -> Column:
        """used: places in b (from 1) taken so far, in the order of a."""
        lo, hi = F.greatest(F.lit(1), i - reach), F.least(m, i + reach)
        places = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        free = F.filter(places, lambda j: (F.get(cb, j - 1) == F.get(ca, i - 1)) & ~F.array_contains(used, j))
        return F.when(F.size(free) > 0, F.array_append(used, F.get(free, F.lit(0)))).otherwise(used)

    used = F.aggregate(F.sequence(F.lit(1), n), F.array().cast("array<int>"), step)
    # The matched letters of a, in order, against those of b, in order.
    def score(u: Column) -> Column:
        k = F.size(u).cast("double")
        ordered = F.array_sort(u)
        wrong = F.size(F.filter(F.arrays_zip(u.alias("x"), ordered.alias("y")), lambda z: F.get(cb, z["x"] - 1) != F.get(cb, z["y"] - 1)))
        one = F.lit(1)  # instead of a zero that the branch above has dealt with
        parts = k / F.greatest(n, one) + k / F.greatest(m, one) + (k - wrong / 2) / F.greatest(k, F.lit(1.0))
        return F.when(k == 0, 0.0).otherwise(parts / 3)

    scored = F.get(F.transform(F.array(used), score), F.lit(0))
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(scored)


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    out = F.lit(0)
    for k in range(1, most + 1):
        whole = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        out = F.when(whole, k).otherwise(out)
    return out


def jaro_winkler(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return F.get(F.transform(F.array(jaro(a, b)), lambda j: j + common_prefix(a, b) * F.lit(0.1) * (1 - j)), F.lit(0))


def tokens(s: Column) -> Column:
    """Telling words, repeats kept."""
    words = F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda t: (F.length(t) > 0) & ~t.isin(*STOPWORDS))


def acronym(s: Column) -> Column:
    capitals = F.lower(F.regexp_replace(s, "[^A-Z]", ""))
    initials = F.array_join(F.transform(tokens(s), lambda t: F.substring(t, 1, 1)), "")
    return F.when(F.length(capitals) >= 2, capitals).otherwise(initials)


def token_subset(a: Column, b: Column) -> Column:
    """Score where one mention's words all occur in the other, else null."""
    ta, tb = tokens(a), tokens(b)
    inside = lambda x, y: F.forall(x, lambda t: F.array_contains(y, t))
    overlap = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    widest = F.greatest(F.size(F.array_distinct(ta)), F.size(F.array_distinct(tb)), F.lit(1))
    score = F.least(F.lit(0.85) + F.lit(0.1) * (overlap / widest), F.lit(0.99))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0) & (inside(ta, tb) | inside(tb, ta)), score)


def jw_possible(a: Column, b: Column) -> Column:
    """False only where Jaro-Winkler cannot exceed 0.9: Jaro is at most (2 + shorter / longer) / 3."""
    n, m = F.length(a), F.length(b)
    top = (2 + F.least(n, m) / F.greatest(n, m, F.lit(1))) / 3
    p = common_prefix(F.lower(a), F.lower(b))
    return top + p * 0.1 * (1 - top) > 0.9 - 1e-9


def verdict(a: Column, b: Column) -> Column:
    """struct<same, method, score>: equal, then Jaro-Winkler above 0.9, then words, then acronyms.

    The score of a pair that is not the same is its Jaro-Winkler similarity."""
    jw, subset, ac = jaro_winkler(a, b), token_subset(a, b), acronym(a)

    def out(same: bool, method: str, score) -> Column:
        score = score if isinstance(score, Column) else F.lit(float(score))
        return F.struct(F.lit(same).alias("same"), F.lit(method).alias("method"), score.alias("score"))

    by_word = (
        F.when(subset.isNotNull(), out(True, "token-subset", subset))
        .when((F.length(ac) >= 2) & (ac == acronym(b)), out(True, "acronym", 0.86))
        .otherwise(out(False, "none", jw))
    )
    return F.when(a == b, out(True, "exact", 1.0)).when(jw > 0.9, out(True, "jaro-winkler", jw)).otherwise(by_word)
