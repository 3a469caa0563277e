"""Problem 5: question and answer pairs whose answer is no proper one, with the kind of defect.

One shuffle by (conversation, turn) both drops repeated deliveries and puts each user message beside the message of the
next turn. Distinct answers are sorted as texts and compared with their neighbour to find shortened versions; lengths at
which far more answers break off than at the lengths around are taken for a length limit. Column rules for empty, copied,
refusal and other language follow; what is left and stops within a sentence is cut off as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.columns import once
from planloom.llm.words import words
from planloom.session import cut

#: Spellings of roles, in lower case without blanks around them.
USER = ("user", "human", "customer", "prompter")
ASSISTANT = ("assistant", "gpt", "model", "bot", "ai", "chatbot")
#: Words in place of an answer.
PLACEHOLDERS = (
    "null", "none", "nil", "n/a", "na", "nan", "undefined", "todo", "tbd", "empty", "blank", "placeholder", "no answer", "no response",
    "answer", "response", "output", "answer here", "your answer here", "insert answer here", "to be added", "not available", "pending",
)
#: An answer in which someone declines, by language.
REFUSALS = (
    # English
    r"\b(?:i|we)(?:\s*'\s*m|\s+am|\s+are|'re)?\s+(?:really\s+|afraid\s+|very\s+)?(?:cannot|can not|can't|could not|couldn't|won't|will not|must decline|have to decline|decline|refuse|unable|not able|not allowed|not permitted|not in a position|not going|would rather not|prefer not|would prefer not|do not want|don't want)\b[^.!?]{0,30}?\b(?:help|assist|answer|solve|provide|produce|work on|comply|do (?:this|that|so)|give|discuss|complete|respond|reply|share|support|fulfil|fulfill|process|offer)",
    r"\bnot (?:something|a (?:task|question|request)) (?:that )?(?:i|we) (?:can|could|will|am able to|am allowed to)\b",
    r"\bno (?:solution|answer|help|result|response) (?:will|can|may|shall) be (?:given|provided|offered|produced)",
    r"\b(?:outside|beyond) (?:of )?what (?:i|we) (?:am|are|can|may)\b",
    r"\b(?:goes|is) against my (?:rules|guidelines|policy|policies|principles)",
    r"\bi must decline\b|\bi have to decline\b",
    # German
    r"\b(?:kann|könnte|darf|möchte|will|werde)\b[^.!?]{0,60}?\b(?:nicht|keine[nr]?)\b[^.!?]{0,40}?\b(?:helfen|beantworten|lösen|lösung|antwort|angeben|geben|bearbeiten|unterstützen)",
    r"\b(?:beantworte|löse|bearbeite)\b[^.!?]{0,20}?\bnicht\b|nicht (?:erlaubt|befugt|in der lage)|\blehne\b[^.!?]{0,40}\bab\b|möchte lieber nicht",
    r"übersteigt[^.!?]{0,30}(?:kann|möglichkeiten)",
    # French
    r"\bje (?:ne|n')\s*(?:peux|puis|suis|veux|vais|saurais|pourrai)\b[^.!?]{0,10}?\b(?:pas|point)\b|\bpréfère ne pas\b|\bdépasse ce que je\b|\bje (?:dois )?refuse|\bje dois décliner|\bil (?:m'est|n'est) (?:impossible|pas possible)",
    # Spanish
    r"\bno (?:puedo|podré|podemos|voy a|quiero|debo|me es posible|estoy autorizad[oa]|estoy en condiciones)\b|\bprefiero no\b|\b(?:está |queda )?fuera de (?:lo que|mi)|\bdebo (?:rechazar|declinar)|\bsupera lo que puedo|\bno daré\b",
    # Italian
    r"\bnon (?:posso|potrò|possiamo|voglio|sono (?:in grado|autorizzat[oa]))\b|\bpreferisco non\b|\bdevo rifiutare",
    # Dutch
    r"\b(?:kan|mag|wil|zal)\b[^.!?]{0,60}?\b(?:niet|geen)\b[^.!?]{0,30}?\b(?:helpen|beantwoorden|oplossen|geven|antwoord)|\b(?:beantwoord)\b[^.!?]{0,20}\bniet\b|liever niet",
    # Portuguese
    r"\bnão (?:posso|poderei|consigo|quero|vou|estou autorizad[oa])\b|\bprefiro não\b",
)
#: Frequent words by which a language is told, chosen to be in few of the other lists.
LANGUAGE_WORDS = {
    "en": "the of and is are was that this with for have has from they it so we then how many what which there after be by an not in at leaves result answer you can which were been their would",
    "de": "der die das und ist sind nicht ein eine wir wie viele im am den dem mit auch zuerst noch wird beträgt lautet aus sich dann zusammen bleiben ergebnis damit also ende denn daher nun weil danach sie es von zu für werden wurde",
    "fr": "le la les des est sont dans une et nous combien avec que pour qui donc du au on il ne pas elle reste obtient réponse total car aussi ajoute maintenant résultat somme alors fin ensuite puis à par ce ces sur parce il leur",
    "es": "el los las una es son y en con que para del cuántos cuántas más se por lo tanto al queda quedan respuesta tenemos entonces primero ahora suma resultado pues también final hay ya después luego porque está fue",
    "it": "il gli una è sono e di con che per del della quanti quante più si dunque quindi alla restano rimangono risposta abbiamo allora prima ora risultato ne fine anche poi nel nella ce adesso perché sono gli successivo",
    "nl": "de het een is zijn niet en van met dat hoeveel er wij ook eerst nog wordt aan dus uit antwoord blijven uitkomst eind dan samen we over daarna worden nu omdat volgende zijn naar maar zij hun door",
    "pt": "o os as uma é são e em com que para do da quantos quantas mais se por isso ao fica ficam resposta temos então primeiro agora soma resultado também não",
}
#: A length limit: so many times as many texts break off there as in the mean at the lengths within ``LIMIT_WINDOW``
#: of it, and so many standard deviations more than that mean lets expect.
LIMIT_TIMES, LIMIT_DEVIATIONS, LIMIT_WINDOW = 8.0, 6.0, 8
#: Words that a text has at least if a text of another question, which goes on within a word, shows it to be cut.
#: Shorter ones can begin alike by chance; they are compared within their own question.
WORDS_TO_TELL = 4


def role_name(c: Column) -> Column:
    plain = F.lower(F.trim(c))
    return F.when(plain.isin(*USER), "user").when(plain.isin(*ASSISTANT), "assistant")


def question_answers(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer, answered): one row per user message; answered if the next turn is the assistant's."""
    rows = messages.select("conv_id", "turn", role_name(F.col("role")).alias("r"), "content").where("r is not null and conv_id is not null and turn is not null")
    user = F.col("r") == "user"
    text = F.struct("content")
    both = rows.groupBy("conv_id", F.when(user, F.col("turn")).otherwise(F.col("turn") - 1).alias("turn")).agg(
        F.max(F.when(user, text)).alias("u"), F.max(F.when(~user, text)).alias("a")
    )
    return both.where("u is not null").select("conv_id", "turn", F.col("u.content").alias("question"), F.col("a.content").alias("answer"), F.col("a").isNotNull().alias("answered"))


def _bare(text: Column) -> Column:
    """A text without tags, code fences and the names of JSON fields."""
    no_fence = F.regexp_replace(text, r"```[A-Za-z]*", " ")
    no_tags = F.regexp_replace(no_fence, r"</?[A-Za-z][^<>]*>|<!--.*?-->|&nbsp;", " ")
    return F.regexp_replace(no_tags, r'"[^"]*"\s*:', " ")


def has_figures(answer: Column) -> Column:
    """Whether an answer surely holds something: a digit outside markup, of a structure a digit in a value."""
    return F.when(is_json(answer), answer.rlike(r':\s*(?:"[^"]*\p{N}|-?\p{N})')).otherwise(answer.rlike(r"\p{N}") & ~answer.contains("<"))


def is_empty(answer: Column) -> Column:
    """No letter or digit beside markup, placeholders and empty structures."""
    left = F.lower(F.trim(F.regexp_replace(_bare(answer), r"[^\p{L}\p{N}/]+", " ")))
    nulls = F.regexp_replace(left, r"\b(?:null|none)\b", " ")
    return answer.isNull() | ~has_figures(answer) & (~left.rlike(r"[\p{L}\p{N}]") | left.isin(*PLACEHOLDERS) | ~nulls.rlike(r"[\p{L}\p{N}]"))


def is_json(answer: Column) -> Column:
    return answer.rlike(r"^\s*(?:```[A-Za-z]*\s*)?[\[{]")


def json_cut_off(answer: Column) -> Column:
    """A structure that isn't closed: it can't be parsed and has more opening than closing brackets, or an open string."""
    body = F.regexp_replace(answer, r"^\s*```[A-Za-z]*\s*", "")
    outside = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*"', "")
    n = lambda chars: F.length(outside) - F.length(F.translate(outside, chars, ""))
    return F.try_parse_json(body).isNull() & ((n("{[") > n("}]")) | (F.length(outside) - F.length(F.translate(outside, '"', "")) == 1))


#: Ends of a complete answer in its result: marked or named, boxed, or nothing but a number and its unit.
_RESULTS = (
    r"(?m)(?:^|[.!?]\s+|\n)\s*#{2,}\s*[-−$€£]?\d[\d.,]*\s*%?[^\n]{0,20}\z"
    r"|(?:^|[.!?]\s+|\n)\s*\**\p{L}{3,}(?: \p{L}+){0,3}\**\s*[:=]\s*\**[-−$€£]?\d[\d.,]*\**\s*(?:%|\p{L}+)?\s*$"
    r"|^\s*[-−$€£]?\d[\d.,]*\s*(?:%|[\p{L}]+)?\s*$"
    r"|\\boxed\{[^{}]*\}\W*$"
)
#: Ends of a complete answer: a sentence's end, or one of ``_RESULTS``.
_ENDS = r"(?<!\.\.)[.!?。！？؟][\s\"'»”’)\]*_`}]*$|" + _RESULTS


def unterminated(answer: Column) -> Column:
    """A text that stops within a sentence, or in dots."""
    tail = F.rtrim(F.right(answer, F.lit(400)), F.lit(" \t\r\n\u00a0\u200b"))  # the ends looked for are shorter
    return tail.rlike(r"(?:\.\.+|…)[\"'”’)\]]*$") | ~tail.rlike(_ENDS)


def language_counts(tokens: Column) -> Column:
    """How many distinct words of ``tokens`` (without repeats) are in each language's list, in the order of the lists."""
    def count(known: str) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(*known.split())))

    return F.array(*map(count, LANGUAGE_WORDS.values()))


def told_language(counts: Column) -> Column:
    """The place, from 1, of the language with most words in ``language_counts``; 0 if there is none, or not only one."""
    top = F.array_max(counts)
    return F.when((top > 0) & (F.size(F.filter(counts, lambda n: n == top)) == 1), F.array_position(counts, top)).otherwise(F.lit(0))


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (g, k): those whose successor of the same g extends k, with how it goes on; and each task's ends."""
    columns = ["kind", "g", "k", "id", "ends", "rest"]
    first = last = None
    for b in batches:
        out = []
        for row in zip(b["g"], b["k"], b["id"], b["ends"]):
            if first is None:
                first = row
            if last is not None and last[0] == row[0] and len(row[1]) > len(last[1]) and row[1].startswith(last[1]):
                out.append(("pair", last[0], None, *last[2:], row[1][len(last[1])]))
            last = row
        if out:
            yield pd.DataFrame(out, columns=columns)
    if first is not None:
        yield pd.DataFrame([("edge", *first, None), ("edge", *last, None)], columns=columns)


#: Marks that sort above and below every other character.
ABOVE, BELOW = "\U0010ffff", "\u0001"


def extended(texts: DataFrame, mark: str) -> DataFrame:
    """(g, id, ends, rest) of the distinct (g, text, id, ends) that another text of the same g extends; rest is its next character or ``mark``.

    For sorting, every character that is no letter or digit gets ``mark`` before it. So of the texts that extend one, all
    of which follow it at once, those that go on with a letter or digit come first (``ABOVE``) or last (``BELOW``), and
    the successor alone tells whether there is one of the kind that comes first. Equal texts are one row and rows are
    split by ranges of their texts, so no text or beginning, however frequent, burdens a task. The first and last row of
    each task (two rows a task) are compared with each other in a second, small sort.
    """
    keyed = texts.select("g", F.regexp_replace("text", r"([^\p{L}\p{N}])", f"{mark}$1").alias("k"), "id", "ends")
    schema = "kind string, g string, k string, id string, ends string, rest string"
    marked = cut(keyed.repartitionByRange("g", "k").sortWithinPartitions("g", "k").mapInPandas(_neighbours, schema))
    w = Window.orderBy("g", "k")  # two rows per task
    edges = marked.where("kind = 'edge'").select("g", "k", "id", "ends").distinct()
    after = edges.select("g", "id", "ends", "k", F.lead("g").over(w).alias("g2"), F.lead("k").over(w).alias("k2"))
    goes_on = F.expr("g = g2 AND startswith(k2, k) AND length(k2) > length(k)")
    rest = F.expr("substring(k2, length(k) + 1, 1)").alias("rest")
    return marked.where("kind = 'pair'").select("g", "id", "ends", "rest").unionByName(after.where(goes_on).select("g", "id", "ends", rest))


def shortened(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of ``answers`` (q, id, text; id tells the text) are beginnings of others: (id) of any answer, (q, id) of one on the same question.

    Of any answer: a text of ``WORDS_TO_TELL`` words or more that another one carries on within its last word. Of one on
    the same question: a text that goes on in any way, but for figures that go on as longer ones. Null and empty texts
    are in neither.
    """
    ends = F.when(F.col("text").rlike(r"\p{L}$"), "letter").when(F.col("text").rlike(r"\p{N}$"), "figure").otherwise("other")
    texts = answers.where("text is not null and text <> ''").groupBy("q", "id").agg(F.min("text").alias("text")).withColumn("ends", ends)
    tells = F.col("text").rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{{WORDS_TO_TELL}}}")
    every = texts.groupBy("id").agg(F.min("text").alias("text")).withColumn("ends", F.when(tells, ends).otherwise("other")).withColumn("g", F.lit(""))
    within = extended(every, ABOVE).where((F.col("ends") == "letter") & (F.col("rest") != ABOVE)).select("id")
    own = extended(texts.withColumnRenamed("q", "g"), BELOW).where((F.col("ends") != "figure") | (F.col("rest") == BELOW)).select(F.col("g").alias("q"), "id")
    return within, own


def length_limits(texts: DataFrame) -> DataFrame:
    """(n_chars) at which far more of the distinct ``texts`` (id, n_chars) break off than at the lengths around."""
    counts = texts.groupBy("id").agg(F.min("n_chars").cast("bigint").alias("n_chars")).groupBy("n_chars").agg(F.count("*").alias("n"))
    lengths = F.explode(F.sequence(F.col("n_chars") - LIMIT_WINDOW, F.col("n_chars") + LIMIT_WINDOW))
    near = counts.select(lengths.alias("n_chars"), "n").groupBy("n_chars").agg(F.sum("n").alias("all"))
    around = (F.col("all") - F.col("n")) / (2.0 * LIMIT_WINDOW)
    expected = F.greatest(around, F.lit(1.0))
    spike = (F.col("n") >= LIMIT_TIMES * around) & (F.col("n") - around >= LIMIT_DEVIATIONS * F.sqrt(expected))
    return counts.join(near, "n_chars").where(spike).select("n_chars")


def features(pairs: DataFrame) -> DataFrame:
    """``pairs`` with what the rules ask of each answer."""
    a = F.col("answer")
    structure = F.coalesce(is_json(a), F.lit(False))
    df = once(
        pairs,
        json=structure,
        empty=~F.col("answered") | is_empty(a),
        qw=words(F.col("question")),
        # the words of a structure with figures aren't asked for: it is no refusal and copies nothing
        aw=F.when(structure & has_figures(a), F.array().cast("array<string>")).otherwise(words(_bare(a))),
    )
    df = once(df, qs=F.array_distinct("qw"), **{"as": F.array_distinct("aw")})
    df = once(df, shared=F.size(F.array_intersect("qs", "as")) / F.greatest(F.size("qs"), F.lit(1)), owned=F.array_except("as", "qs"))
    return df.withColumns({"own": F.size("owned"), "numbers_own": F.size(F.filter("owned", lambda w: w.rlike(r"\p{N}")))})


def judged(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, defect, step) of every pair with a defect, and of a truncated one by which step it is known.

    Steps: 'prefix' a longer version is known, 'limit' it breaks off at a length limit, 'structure' JSON that isn't
    closed, 'ending' it stops within a sentence; in that order. See ``defects`` for the rest.
    """
    pairs = question_answers(messages)
    f = features(pairs)
    texts = ~F.col("json") & ~F.col("empty") & (F.col("own") >= 2)
    f = once(f, al=F.when(texts, language_counts(F.col("as"))), ql=F.when(texts, language_counts(F.col("qs"))))
    f = once(f, most=F.array_max("al"), answered_in=told_language(F.col("al")), asked_in=told_language(F.col("ql")))
    # nearly all of the question and hardly a word of its own; cut in dots or not
    restates = F.col("answer").rlike(r"(?i)^\W*the (?:question|problem|task) (?:was|is|reads)")
    f = once(f, stops=~F.col("json") & ~F.col("empty") & unterminated(F.col("answer")))
    stops = F.col("stops")
    copied = (
        (F.size("qs") >= 4) & (F.col("shared") >= 0.6) & (F.col("numbers_own") == 0) & (F.col("own") <= 1 + 0.06 * F.size("as"))
        & (F.size("aw") >= 0.5 * F.size("qw")) & (F.size("aw") <= 1.3 * F.size("qw") + 6) & ~F.col("json") & ~(restates & stops)
    )
    said = F.lower(F.regexp_replace("answer", "[’‘`´]", "'"))
    refusal = (
        (F.col("numbers_own") == 0) & (F.size("aw") > 0) & ~F.col("answer").rlike(r"\d\s*=|=\s*\d") & said.rlike("|".join(f"(?:{r})" for r in REFUSALS))
    )
    # an answer told to be of another language, with clearly more words of it than of the question's
    asked_in = F.col("asked_in")
    other = (
        (F.col("most") >= 2) & (F.col("answered_in") > 0) & (asked_in > 0) & (asked_in != F.col("answered_in"))
        & (F.col("most") >= 1.5 * F.try_element_at("al", asked_in.cast("int")) + 1)
    )
    rule = F.when(F.col("empty"), "empty").when(copied, "copied").when(refusal, "refusal").when(other, "other_language")
    text = F.rtrim("answer", F.lit(" \t\r\n"))
    answers = cut(
        once(f, rule=rule, text=F.when(~F.col("empty") & ~F.col("json"), text)).select(
            "conv_id", "turn", "rule", "text", "stops",
            F.md5(F.concat_ws(" ", "qw")).alias("q"),
            F.md5("text").alias("id"),
            F.length("text").alias("n_chars"),
            (F.col("json") & ~F.col("empty") & json_cut_off(F.col("answer"))).alias("open"),
            # a text that ends as one, or in the result itself, or is a result as a whole
            F.col("text").rlike(r"[.!?}\]\"`]$").alias("closed"),
            F.right("text", F.lit(400)).rlike(_RESULTS).alias("results"),
        )
    )
    said_all = answers.where("text is not null")
    within, own = shortened(said_all)
    limits = length_limits(said_all.where("not closed and not results").select("id", "n_chars"))
    yes = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    marked = answers.join(yes(within, "within"), "id", "left").join(yes(own, "longer"), ["q", "id"], "left").join(yes(limits, "limit"), "n_chars", "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    shorter = is_("within") | (is_("longer") & ~F.col("results"))
    step = (
        F.when(shorter, "prefix").when(is_("limit") & ~F.col("closed") & ~F.col("results"), "limit").when(is_("open"), "structure").when(is_("stops"), "ending")
    )
    out = marked.select("conv_id", "turn", F.coalesce("rule", F.when(step.isNotNull(), "truncated")).alias("defect"), F.when(F.col("rule").isNull(), step).alias("step"))
    return out.where("defect is not null")


def defects(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, defect): each pair that has a defect; see TESTDATA for the kinds. A pair has one at most.

    Of several defects that hold, empty, copied, refusal, other_language, truncated is the order. Null or unknown roles
    belong to neither side; rows with a null conversation or turn are left out; a null question has no language and no
    words.
    """
    return judged(messages).select("conv_id", "turn", "defect")


def shortened_answers(messages: DataFrame) -> DataFrame:
    """(kind, q, id): answers, by the MD5 of their text, that are beginnings of others: 'within' of any, 'own' of one on the same question q."""
    said = question_answers(messages).select(F.md5(F.concat_ws(" ", words(F.col("question")))).alias("q"), F.rtrim("answer", F.lit(" \t\r\n")).alias("text"))
    within, own = shortened(said.withColumn("id", F.md5("text")))
    return within.distinct().select(F.lit("within").alias("kind"), F.lit("").alias("q"), "id").unionByName(own.distinct().select(F.lit("own").alias("kind"), "q", "id"))


def truncation_steps(messages: DataFrame) -> DataFrame:
    """(step, n_pairs): by which step the truncated answers are known."""
    return judged(messages).where("defect = 'truncated'").groupBy("step").agg(F.count("*").alias("n_pairs"))


def defect_counts(messages: DataFrame) -> DataFrame:
    """(defect, n_pairs) over all pairs, and with defect 'none' the pairs without one."""
    pairs = messages.select("conv_id", "turn", role_name(F.col("role")).alias("r")).where("r = 'user' and conv_id is not null and turn is not null")
    total = pairs.dropDuplicates(["conv_id", "turn"]).count()
    bad = defects(messages).groupBy("defect").agg(F.count("*").alias("n_pairs"))
    none = bad.agg((F.lit(total) - F.coalesce(F.sum("n_pairs"), F.lit(0))).alias("n_pairs")).select(F.lit("none").alias("defect"), "n_pairs")
    return bad.unionByName(none)
