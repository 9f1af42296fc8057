"""Line-first cleaning: line rules, then a verdict on what is left of the document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table

#: Fixed values. Phrases of boilerplate lines, in lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "subscribe to our", "click here", "enable javascript", "licensed under", "copyright (c)")
#: Fixed values. Tokens that separate the entries of a navigation bar.
SEPARATORS = ("|", "»", "›", ">", "•", "·", "/")


def let(name: str, expr: str) -> str:
    """A generator of one row, so that Spark computes expr once however often the column is used."""
    return f"explode(array({expr})) as {name}"


def judge_lines(
    docs: DataFrame,
    max_loss: float = 0.5,
    max_punctuation: float = 0.15,
    min_line_chars: int = 20,
    max_separators: float = 0.2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, line rules and verdict of each document.

    Lines (split at \\n) fail if they have at least min_line_chars characters of words of which a share over
    max_punctuation is ASCII punctuation; if over max_separators of their words, two at least, are navigation
    separators; or if they contain a boilerplate phrase. clean_text is the text without its failing lines. kept is
    false if base_failed, or if the failing lines hold over max_loss of the words.

    Base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words covered by 5-word windows that
    occur twice or more), base_failed (n_words < 10 or 100 * n_repeat_words > 20 * n_words). Windows are compared
    by 64-bit hashes within one text. Null or empty text: all counts 0, base_failed. Other columns are ignored,
    repeated rows are judged each. Cost is n log n in the longest text, only where windows do repeat; no shuffle.
    """
    quoted = ", ".join(f"'{s}'" for s in SEPARATORS)
    phrases = " or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    fails = f"""(size(lw) >= 1 and (
        (length(array_join(lw, '')) >= {min_line_chars} and length(regexp_replace(array_join(lw, ''), '[^!-/:-@\\\\[-`{{-~]+', '')) > {max_punctuation}D * length(array_join(lw, '')))
        or (size(filter(lw, w -> w in ({quoted}))) >= 2 and size(filter(lw, w -> w in ({quoted}))) > {max_separators}D * size(lw))
        or {phrases}))"""
    split_words = lambda x: f"filter(split({x}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    hashes = "transform(sequence(1, size(words) - 4), i -> xxhash64(words[i - 1], words[i], words[i + 1], words[i + 2], words[i + 3]))"
    # positions of repeated windows: sorted by (hash, position), a window repeats if a neighbour has its hash
    ordered = "sort_array(transform(hashes, (h, i) -> struct(h, i)))"
    repeated = "array_sort(transform(filter(ordered, (x, k) -> (k > 0 and ordered[k - 1].h = x.h) or (k + 1 < size(ordered) and ordered[k + 1].h = x.h)), x -> x.i))"
    covered = "aggregate(transform(repeated, (p, k) -> if(k + 1 < size(repeated), least(5, repeated[k + 1] - p), 5)), 0L, (a, x) -> a + x)"
    out = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .selectExpr("id", "text", let("words", split_words("text")))
        .selectExpr("id", "text", "words", let("hashes", f"if(size(words) < 5, cast(array() as array<bigint>), {hashes})"))
        .selectExpr("id", "text", "words", let("ordered", f"if(size(array_distinct(hashes)) = size(hashes), cast(array() as array<struct<h:bigint,i:int>>), {ordered})"))
        .selectExpr("id", "text", "words", let("repeated", repeated))
        .selectExpr(
            "id",
            "text",
            "cast(size(words) as bigint) as n_words",
            "cast(length(array_join(words, '')) as bigint) as word_chars",
            "cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) as bigint) as n_symbols",
            f"{covered} as n_repeat_words",
            "split(text, '\\n') as all_lines",
        )
        .selectExpr(
            "*",
            let("lines", f"transform(transform(all_lines, line -> struct(line, {split_words('line')} as lw)), x -> struct(x.line as line, size(x.lw) as n, {fails.replace('lw', 'x.lw').replace('lower(line)', 'lower(x.line)')} as bad))"),
        )
        .selectExpr("*", "filter(lines, x -> x.n > 0).line as full_lines")
        .selectExpr(
            f"id as `{id_col}`",
            "n_words",
            "word_chars",
            "n_symbols",
            "cast(size(full_lines) - size(array_distinct(full_lines)) as bigint) as n_dup_lines",
            "n_repeat_words",
            "n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed",
            "aggregate(filter(lines, x -> x.bad), 0L, (a, x) -> a + x.n) as lost_words",
            "array_join(filter(lines, x -> not x.bad).line, '\\n') as clean_text",
        )
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.lit(float(max_loss)) * F.col("n_words")))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The kept documents with clean_text for their text, as (id, text)."""
    return judge_lines(docs, id_col=id_col, text_col=text_col, **limits).filter("kept").select(id_col, F.col("clean_text").alias(text_col))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, and the digest of what cleaning leaves of each."""
    judged = judge_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", F.sha2("clean_text", 256).alias("clean_sha256"))


OP3_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
win as (select doc_id, i, [words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]] as w from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from win) where n > 1),
cov as (select doc_id, count(distinct i + k)::bigint as n from rep, (select unnest(range(0, 5)) as k) group by doc_id),
ln as (select doc_id, i, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as lw from (select doc_id, i, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from d)))),
bad as (select doc_id, i, line, len(lw) as n, len(lw) >= 1 and (
   (length(array_to_string(lw, '')) >= 20 and length(regexp_replace(array_to_string(lw, ''), '[^!-/:-@\\[-`{{-~]+', '', 'g')) > 0.15e0 * length(array_to_string(lw, '')))
   or (len(list_filter(lw, lambda w: w in ('|', '»', '›', '>', '•', '·', '/'))) >= 2 and len(list_filter(lw, lambda w: w in ('|', '»', '›', '>', '•', '·', '/'))) > 0.2e0 * len(lw))
   or {" or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}) as bad from ln),
agg as (select doc_id, (count(*) filter (n > 0) - count(distinct line) filter (n > 0))::bigint as n_dup_lines, coalesce(sum(n) filter (bad), 0)::bigint as lost_words,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not bad), '')) as clean_sha256 from bad group by doc_id),
r as (select d.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, lost_words, clean_sha256
  from d left join cov using (doc_id) left join agg using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, clean_sha256, not base_failed and lost_words <= 0.5e0 * n_words as kept
from (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from r)
"""
