"""Quality rules under weak supervision (DataFrame functions only).

Rules vote for or against a document or abstain. Expectation-maximisation over the counts
of vote patterns estimates, for each rule, how often it votes either way on good and on
bad documents, and each pattern's posterior probability of good quality decides. A rule
may be found to be noise, so that its vote alone does not reject, or to see a kind of junk
that no other rule sees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import SPACES, cut, let, words_of

RULES = ("symbols", "capitals", "exclaims", "lines", "repeats", "stutter", "endings")
#: With nothing to tell noise by, the share of a rule's lone votes against that is taken for noise; weighs as one document.
SOUND = 0.25


def _repeated(words: Column) -> Column:
    """Words in 5-word windows that a text holds twice or more."""
    index = lambda xs, less: F.sequence(F.lit(0), F.size(xs) - less)

    def covered(windows: Column) -> Column:
        numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            at = lambda j: F.get(s, j).getField("h")
            again = F.filter(s, lambda x, j: (x.h == at(j - 1)) | (x.h == at(j + 1)))
            starts = F.array_sort(F.transform(again, lambda x: x.i))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct((p + 5).alias("end"), (a.n + p + 5 - F.greatest(p, a.end)).alias("n"))
            return F.aggregate(starts, zero, step, lambda a: a.n)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(numbered, marked))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(index(h, 5), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(let(hashes, windows), covered))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read; every whole text, null as no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(rf"[^{SPACES}]"))),
        lambda x: F.struct(
            F.size(x).alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            F.size(F.filter(x, lambda y: F.regexp_like(y, F.lit(rf"[.!?…:;。！？][\"'»”)\]]*[{SPACES}]*$")))).alias("ended"),
        ),
    )
    words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            _repeated(w).alias("repeated"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("stutter"),
        ),
    )
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    rows = docs.select(
        "doc_id",
        words.alias("w"),
        lines.alias("l"),
        F.length(F.regexp_replace(text, rf"[{SPACES}]+", "")).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("capitals"),
        count("!").alias("exclaims"),
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select(
        "doc_id", long("w.n", "n_words"), long("word_chars", "word_chars"), long("n_symbols", "n_symbols"), long("l.dup", "n_dup_lines"),
        long("w.repeated", "n_repeat_words"), long("w.stutter", "n_stutter"), long("l.n", "n_lines"), long("l.ended", "n_ended"),
        long("capitals", "n_capitals"), long("exclaims", "n_exclaims"),
    )


def votes() -> list[Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains (between its bounds, or nothing to judge)."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def vote(share: Column, good: float, bad: float, judged: Column) -> Column:
        return F.when(~judged, 0).when(share >= bad, -1).when(share <= good, 1).otherwise(0)

    some = F.col("n_words") > 0
    return [
        vote(per("n_symbols", "n_words"), 0.02, 0.1, some),
        vote(per("n_capitals", "word_chars"), 0.15, 0.35, F.col("n_words") >= 5),
        vote(per("n_exclaims", "n_words"), 0.05, 0.25, some),
        vote(per("n_dup_lines", "n_lines"), 0.1, 0.4, F.col("n_lines") >= 4),
        vote(per("n_repeat_words", "n_words"), 0.05, 0.3, F.col("n_words") >= 10),
        vote(F.greatest(F.col("n_stutter") - 1, F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1)), 0.04, 0.12, F.col("n_words") >= 5),
        vote(1 - per("n_ended", "n_lines"), 0.4, 0.9, F.col("n_lines") >= 3),
    ]


def own_kinds(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, float]:
    """For rules that see a kind of junk of their own, the share of their lone votes against that it explains.

    If there were but good and bad documents, a rule would vote against documents that
    others vote against as often as the rest, if it is noise, or more often. What it votes
    against the rest more often than that is junk that no other rule sees. One
    pseudo-document, at ``SOUND``, decides where others vote against nothing.
    """
    found = {}
    for j in range(len(patterns[0][0]) if patterns else 0):
        n = {(others, own): 0.0 for others in (True, False) for own in (True, False)}
        for v, count in patterns:
            if v[j]:
                n[-1 in v[:j] + v[j + 1 :], v[j] == -1] += count
        alone = (n[False, True] + 0.5) / (n[False, True] + n[False, False] + 1)
        beside = (n[True, True] + SOUND * alone) / (n[True, True] + n[True, False] + 1)
        if beside < alone:
            found[j] = 1 - beside / alone
    return found


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.8) -> tuple[dict, list[dict]]:
    """Posteriors of good quality by vote pattern, and each rule's vote rates by class (1 good, 0 bad).

    ``patterns``: (votes, documents), at most 3 ** rules of them whatever the corpus, so
    they fit the driver. The start alone tells the classes apart: patterns without a vote
    against are good. No rate is bounded; each has one pseudo-count. Besides the bad
    documents there is a class of junk for each of ``own_kinds``: its rule votes against
    it, the others vote on it as on good documents. Its share and the rule's rate against
    good documents part one pseudo-count as they part the rule's lone votes at the start.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    own = own_kinds(patterns)
    classes = [1, 0, *(2 + j for j in own)]
    of_class: dict[tuple[int, ...], dict[int, float]] = {}
    for v, _ in patterns:
        good = 0.95 if -1 not in v and 1 in v else prior if -1 not in v else 0.02
        of_class[v] = dict.fromkeys(classes, 0.0) | {1: good, 0: 1 - good}
        lone = v.index(-1) if v.count(-1) == 1 else None
        if lone in own:
            of_class[v] |= {1: 1 - own[lone], 0: 0.0, 2 + lone: own[lone]}
    rates: list[dict] = []
    total = sum(n for _, n in patterns)
    pseudo = {1: prior, 0: 1 - prior} | {2 + j: s for j, s in own.items()}
    for _ in range(rounds):
        share = {c: (sum(of_class[v][c] * n for v, n in patterns) + pseudo[c]) / (total + sum(pseudo.values())) for c in classes}
        rates = []
        for j in range(n_rules):
            of = {}
            for kind in (1, 0):
                mass = {-1: 1 - own.get(j, 0.0) if kind else 1.0, 0: 1.0, 1: 1.0}
                alike = [0] if kind == 0 else [c for c in classes if c not in (0, 2 + j)]
                for v, n in patterns:
                    mass[v[j]] += n * sum(of_class[v][c] for c in alike)
                whole = sum(mass.values())
                of[kind] = {x: m / whole for x, m in mass.items()}
            rates.append(of)
        before = of_class
        of_class = {}
        for v, _ in patterns:
            log = {}
            for c in classes:
                if c < 2 or v[c - 2] == -1:  # a vote against is certain on junk of a rule's own
                    log[c] = math.log(share[c]) + sum(math.log(rates[j][min(c, 1)][x]) for j, x in enumerate(v) if x and j != c - 2)
            most = max(log.values())
            whole = sum(math.exp(x - most) for x in log.values())
            of_class[v] = {c: math.exp(log[c] - most) / whole if c in log else 0.0 for c in classes}
        if max((abs(of_class[v][1] - before[v][1]) for v in of_class), default=0) < 1e-9:
            break
    return {v: p[1] for v, p in of_class.items()}, rates


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts of ``features``, base_failed, quality (posterior), kept.

    One row for each input row. Null and empty texts have no words and fail the base rule
    of ten words. Repeated rows and ties are judged alike. Empty tables give no rows.
    """
    rows = features(docs).withColumn("votes", F.array(*[v.cast("int") for v in votes()]))
    rows = cut(rows)
    seen = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).limit(3 ** len(RULES)).collect()
    good, _ = estimate(sorted((tuple(r["votes"]), r["n"]) for r in seen))
    table = rows.sparkSession.createDataFrame([(list(v), float(q)) for v, q in good.items()], "votes array<int>, quality double")
    out = rows.join(F.broadcast(table), "votes")  # at most 3 ** rules rows
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return out.drop("votes")
