"""Conversations to facts (P1 to P7, W10, A3 to A5), histories and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import lexicons
from marlstone.functions.text import message_text, quote_form, sentences, words


def _among(word: Column, values: Sequence[str]) -> Column:
    return F.coalesce(word.isin(list(values)), F.lit(False))


def _pair(found: Column, i: int) -> Column:
    return F.concat_ws(" ", F.get(found, i), F.get(found, i + 1))


def is_question(sentence: Column) -> Column:
    return F.rtrim(sentence).endswith("?")


def is_imperative(first: Column) -> Column:
    """P4; ``first``: the sentence's first five words."""
    verbs = list(lexicons.IMPERATIVES)
    out = _among(F.get(first, 0), [*verbs, *lexicons.REQUESTS]) | _pair(first, 0).isin(list(lexicons.REQUEST_PAIRS))
    for i in (1, 2, 3):
        out |= _among(F.get(first, i), verbs)
    return out


def is_first_person(found: Column) -> Column:
    """P5; ``found``: all words of the sentence."""
    text = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    return F.exists(found, lambda w: w.isin(list(lexicons.FIRST_PERSON))) | text.rlike(f" (?:{'|'.join(lexicons.FIRST_PERSON_PAIRS)}) ")


def is_addressed(first: Column) -> Column:
    """P6 but for the first person: about the one spoken to."""
    out = _among(F.get(first, 0), lexicons.ADDRESSED_FIRST) | (_among(F.get(first, 0), ["non"]) & _among(F.get(first, 1), lexicons.ADDRESSED_AFTER_NOT))
    return out | F.exists(first, lambda w: w.isin(list(lexicons.ADDRESSED_ANY)))


def verdict(sentence: Column, found: Column, me: Column) -> Column:
    """Why a sentence is no fact, or ``prima persona`` if it is one. The first reason counts.

    found, me: columns with the sentence's words and whether it is of the first person, made in
    steps before so that neither is made again for each rule."""
    first = F.slice(found, 1, 5)
    return (
        F.when(F.trim(sentence) == "", "vuota")
        .when(is_question(sentence), "domanda")
        .when(is_imperative(first), "imperativo")
        .when(~me & is_addressed(first), "sull'assistente")
        .when(F.size(found) < 2, "troppo breve")
        .when(me, "prima persona")
        .otherwise("non sul parlante")
    )


def judged(sentences_: DataFrame) -> DataFrame:
    """``sentences_`` with reason (P7) of its column sentence."""
    return judged_words(sentences_.withColumn("_cut", F.explode(F.array(F.struct(words(F.col("sentence")).alias("found"))))).withColumn("_found", F.col("_cut.found")).drop("_cut"))


def judged_words(cut: DataFrame) -> DataFrame:
    """``judged`` of sentences whose words (_found) were cut already."""
    return cut.withColumn("_me", is_first_person(F.col("_found"))).withColumn("reason", verdict(F.col("sentence"), F.col("_found"), F.col("_me"))).drop("_found", "_me")


def classified(messages: DataFrame, *, by: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """``by, seq, sentence, reason``: the sentences of the users' messages (columns role, text).

    The role is filtered before anything is cut, and each sentence's words are cut once.
    """
    each = F.transform(sentences(message_text(F.col("text"))), lambda s: F.struct(s.alias("sentence"), words(s).alias("found")))
    cut = messages.where("role = 'user'").select(*by, F.posexplode(each).alias("seq", "_cut"))
    return judged_words(cut.select(*by, "seq", F.col("_cut.sentence").alias("sentence"), F.col("_cut.found").alias("_found")))


def facts(messages: DataFrame, *, by: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """``classified`` and kind: fact, context or discarded. Sentences that say nothing about
    the speaker are context where their message has a fact."""
    found = classified(messages, by=by).withColumn("_fact", F.col("reason") == "prima persona")
    any_ = F.max("_fact").over(Window.partitionBy(*by))
    kind = F.when(F.col("_fact"), "fact").when(any_ & (F.col("reason") == "non sul parlante"), "context").otherwise("discarded")
    return found.withColumn("kind", kind).drop("_fact")


def quotes(observation: Column) -> Column:
    """what stands in quotation marks, else the observation without its bullet and label."""
    inside = F.filter(F.regexp_extract_all(observation, F.lit('"([^"]+)"'), F.lit(1)), lambda q: q != "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(observation, "^- ", ""), "^EXPLICIT:", ""))
    return F.when(F.size(inside) > 0, inside).when(bare != "", F.array(bare)).otherwise(F.expr("cast(array() as array<string>)"))


def longest_run(found: Column, text: Column, most: int = 15, least: int = 4) -> Column:
    """Length of the longest run of words (``most`` down to ``least``, the first of equals) that the
    text holds, else 0. found: a column with the words."""
    n = F.size(found)
    sizes = F.when(n > 0, F.sequence(F.least(F.lit(most), n), F.least(F.lit(least), n), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(found, i, k), " "))))
    return F.coalesce(F.length(F.get(F.filter(runs, lambda r: F.contains(text, r)), 0)), F.lit(0))


def common_length(quote: Column, found: Column, text: Column) -> Column:
    """F8: length of the quote if the text holds it, else of its longest run of words that does, else
    0. Both in ``quote_form``; found: a column with the quote's words."""
    return F.when((quote == "") | (text == ""), 0).when(F.contains(text, quote), F.length(quote)).otherwise(longest_run(found, text))


def attributed(quoted: DataFrame, messages: DataFrame, *, accepted: int = 16) -> DataFrame:
    """``conv_id, quote_id, quoted_role, match_len``: who said what is quoted.

    quoted: conv_id, quote_id, quote. A quote meets the messages of its conversation; the longest
    common run wins, the earliest message among equals. Quotes of fewer than 20 characters, and
    runs of fewer than ``accepted``, name nobody.
    """
    said = messages.select("conv_id", "turn", "role", quote_form(F.coalesce("text", F.lit(""))).alias("_text"))
    asked = quoted.select("conv_id", "quote_id", quote_form(F.col("quote")).alias("_quote")).withColumn("_found", words(F.col("_quote")))
    met = asked.join(said, "conv_id", "left").withColumn("_len", F.when(F.length("_quote") >= 20, common_length(F.col("_quote"), F.col("_found"), F.coalesce("_text", F.lit("")))).otherwise(0))
    best = met.groupBy("conv_id", "quote_id").agg(F.max(F.struct(F.col("_len"), (-F.col("turn")).alias("_first"), F.col("role"))).alias("_best"))
    return best.select("conv_id", "quote_id", F.when(F.col("_best._len") >= accepted, F.col("_best.role")).alias("quoted_role"), F.col("_best._len").cast("long").alias("match_len"))


def attributed_by_id(quoted: DataFrame, messages: DataFrame) -> DataFrame:
    """``conv_id, quote_id, quoted_role, match_len`` of quotes that name their message (conv_id,
    quote_id, turn, quote): its role if it holds the quote, a quote's only word, or else a run of the
    quote's words, from 15 down to 2; nobody and 0 if not, or if there is no such message."""
    said = messages.select("conv_id", "turn", "role", quote_form(F.coalesce("text", F.lit(""))).alias("_text")).withColumn("_said", words(F.col("_text")))
    asked = quoted.select("conv_id", "quote_id", "turn", quote_form(F.coalesce("quote", F.lit(""))).alias("_quote")).withColumn("_found", words(F.col("_quote")))
    met = asked.join(said, ["conv_id", "turn"], "left")
    one = F.when((F.size("_found") == 1) & F.array_contains("_said", F.get("_found", F.lit(0))), F.length(F.get("_found", F.lit(0))))
    runs = F.when(F.size("_found") > 1, longest_run(F.col("_found"), F.array_join("_said", " "), least=2))
    length = F.when(F.col("role").isNull() | (F.col("_quote") == ""), 0).when(F.contains("_text", "_quote"), F.length("_quote")).otherwise(F.coalesce(one, runs, F.lit(0)))
    return met.withColumn("_len", length).select("conv_id", "quote_id", F.when(F.col("_len") > 0, F.col("role")).alias("quoted_role"), F.col("_len").cast("long").alias("match_len"))


def error_rates(found: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Counts of roles (column quoted_role) by ``by`` and in total, with the share of quotes
    that the assistant said; 0 for none."""
    count = lambda c: F.count_if(c).cast("long")
    rolled = found.rollup(*by).agg(F.count(F.lit(1)).alias("n_quotes"), count(F.col("quoted_role") == "user").alias("n_user"), count(F.col("quoted_role") == "assistant").alias("n_assistant"), count(F.col("quoted_role").isNull()).alias("n_none"))
    return rolled.withColumn("wrong_share", F.coalesce(F.try_divide("n_assistant", "n_quotes"), F.lit(0.0)))


def headers(messages: DataFrame) -> DataFrame:
    """The archive's header rows: a row for each conversation."""
    return messages.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").cast("long").alias("n_user"))


def transcripts(messages: DataFrame) -> DataFrame:
    """the conversation as lines of ``[role] text``, blank messages left out."""
    said = messages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    held = F.array_sort(F.collect_list(F.struct("turn", F.format_string("[%s] %s", "role", F.trim("text")).alias("line"))))
    return said.groupBy("conv_id").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("transcript"))
