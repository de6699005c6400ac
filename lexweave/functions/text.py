"""Scalar text functions as Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END, UNK = "<s>", "</s>", "<UNK>"
WORD = r"^[\p{L}\p{N}_]+$"
ASCII_WORD = r"^[a-z]+(?:'[a-z]+)?$"
TOKEN = r"([A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+|[^\p{L}\p{N}_\s])"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Tags of other schemes and the treebank tag that each is read as.
TAG_MAP = {
    "AT": "DT", "DET": "DT", "DT": "DT", "NN": "NN", "NNS": "NNS", "NP": "NNP", "NPS": "NNPS", "NOUN": "NN", "PROPN": "NNP", "VB": "VB",
    "VBD": "VBD", "VBG": "VBG", "VBN": "VBN", "VBP": "VBP", "VBZ": "VBZ", "VERB": "VB", "AUX": "VB", "BE": "VB", "BED": "VBD", "BEDZ": "VBD",
    "BEG": "VBG", "BEM": "VBP", "BEN": "VBN", "BER": "VBP", "BEZ": "VBZ", "HV": "VB", "HVD": "VBD", "HVG": "VBG", "HVN": "VBN", "HVZ": "VBZ",
    "DO": "VB", "DOD": "VBD", "DOG": "VBG", "DON": "VBN", "DOZ": "VBZ", "MD": "MD", "JJ": "JJ", "JJR": "JJR", "JJS": "JJS", "ADJ": "JJ",
    "RB": "RB", "RBR": "RBR", "RBS": "RBS", "RBT": "RBS", "ADV": "RB", "QL": "RB", "PP$": "PRP$", "PPO": "PRP", "PPS": "PRP", "PPSS": "PRP",
    "PN": "PRP", "PRP": "PRP", "PRP$": "PRP$", "PRON": "PRP", "IN": "IN", "CS": "IN", "CC": "CC", "ADP": "IN", "CCONJ": "CC", "SCONJ": "IN",
    "CD": "CD", "NUM": "CD", "OD": "JJ", "RP": "RP", "PRT": "RP", "TO": "TO", "UH": "UH", "INTJ": "UH", "EX": "EX", "FW": "FW", "WDT": "WDT",
    "WP": "WP", "WP$": "WP$", "WRB": "WRB", ".": ".", ",": ",", ":": ":", ";": ":", "(": "(", ")": ")", "--": ":", "PUNCT": ".",
}
#: Words whose immediate repetition is an anomaly.
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is", "was", "were", "are", "be",
    "been", "that", "this", "these", "those", "it", "he", "she", "they", "we", "i", "his", "her", "their", "its", "my", "your", "our", "not",
    "no", "so",
)


def normalize_word(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"^\s+|\s+$", ""))


def is_word(w: Column) -> Column:
    """Letters, digits and underscores, with at least one letter."""
    return w.rlike(WORD) & w.rlike(r"\p{L}")


def is_ascii_word(w: Column) -> Column:
    return normalize_word(w).rlike(ASCII_WORD)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def detokenize(tokens: Column) -> Column:
    """Joins tokens: no space before closing marks, none after a token that ends in an opening one. Each token takes its separator from
    the one before it, so the work is linear in the text."""
    close, open_ = list(".,!?;:)]}'\""), list("([{\"")
    glued = lambda t, before: before.isNull() | t.isin(close) | F.right(before, F.lit(1)).isin(open_)
    before = F.concat(F.array(F.lit(None).cast("string")), tokens)
    parts = F.zip_with(tokens, F.slice(before, F.lit(1), F.greatest(F.size(tokens), F.lit(0))), lambda t, b: F.when(glued(t, b), t).otherwise(F.concat(F.lit(" "), t)))
    return F.array_join(parts, "")


def match_case(source: Column, word: Column) -> Column:
    upper = (F.length(source) > 1) & (source == F.upper(source)) & (source != F.lower(source))
    first = F.substring(source, 1, 1)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))
    return F.when(upper, F.upper(word)).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(word)


def deletion_variants(w: Column) -> Column:
    n = F.length(w)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.when(n > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def edits1(w: Column) -> Column:
    """Deletes, transposes, replaces and inserts over a-z, without the word itself."""
    n, abc = F.length(w), F.array(*[F.lit(c) for c in LETTERS])
    head, tail = (lambda i: F.substr(w, F.lit(1), i)), (lambda i: F.substr(w, i + 1))
    at = F.sequence(F.lit(0), n)
    inside = F.filter(at, lambda i: i < n)
    swaps = F.transform(F.filter(at, lambda i: i < n - 1), lambda i: F.concat(head(i), F.substr(w, i + 2, F.lit(1)), F.substr(w, i + 1, F.lit(1)), F.substr(w, i + 3)))
    drops = F.transform(inside, lambda i: F.concat(head(i), tail(i + 1)))
    puts = F.flatten(F.transform(inside, lambda i: F.transform(abc, lambda c: F.concat(head(i), c, tail(i + 1)))))
    adds = F.flatten(F.transform(at, lambda i: F.transform(abc, lambda c: F.concat(head(i), c, tail(i)))))
    return F.array_except(F.concat(drops, swaps, puts, adds), F.array(w))


def within_edit_one(a: Column, b: Column) -> Column:
    """Levenshtein distance at most 1, or one transposition of neighbours."""
    d, n = F.levenshtein(a, b), F.length(a)
    swapped = F.exists(
        F.filter(F.sequence(F.lit(1), n), lambda i: i < n),
        lambda i: (F.substr(a, F.lit(1), i - 1) == F.substr(b, F.lit(1), i - 1)) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1)))
        & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, i + 2) == F.substr(b, i + 2)),
    )
    return (F.abs(n - F.length(b)) <= 1) & ((d <= 1) | ((d == 2) & (n == F.length(b)) & swapped))


def morphology_tag(upos: Column, feats: Column) -> Column:
    m = F.str_to_map(F.coalesce(F.when(feats != "_", feats), F.lit("")), F.lit("\\|"), F.lit("="))
    gender, number = F.try_element_at(m, F.lit("Gender")), F.try_element_at(m, F.lit("Number"))
    return F.concat_ws("-", upos, F.when(gender.isin("Masc", "Fem", "Neut"), gender), F.when(number == "Sing", "Sg").when(number == "Plur", "Pl"))


def reconcile_tag(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TAG_MAP.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.split(tag, "-")[0]), F.try_element_at(table, tag), F.lit("NN"))


def usable_word(w: Column) -> Column:
    return (F.length(w) >= 2) | w.isin("a", "i")


def surface_issues(tokens: Column) -> Column:
    """Repeated function words, then tripled words, joined by '; ' (null where there are none). Places where a word comes twice are found
    in one pass; only these are looked at again. ``tokens`` should be a column, not an expression."""
    words = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    twice = F.zip_with(tokens, rest, lambda a, b: (a == b) | (F.lower(a) == F.lower(b)))
    at = F.filter(F.transform(twice, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    pairs = F.filter(at, lambda i: F.array_contains(words, F.lower(F.get(tokens, i))))
    thrice = F.filter(at, lambda i: F.lower(F.get(tokens, i)) == F.lower(F.get(tokens, i + 2)))
    said = F.concat(
        F.transform(pairs, lambda i: F.concat(F.lit("repeated function word '"), F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1), F.lit("'"))),
        F.transform(thrice, lambda i: F.concat(F.lit("token '"), F.get(tokens, i), F.lit("' repeated three times"))),
    )
    return F.when(F.size(said) > 0, F.array_join(said, "; "))


def decision_rule(parseable: Column, tri: Column, bi: Column, low: float = 350, high: float = 800, bigram: float = 650) -> Column:
    """(verdict, method) as a struct."""
    return F.struct(
        F.when(tri < low, "Grammatical").when(tri < high, "Ungrammatical").when(bi < bigram, "Grammatical").otherwise("Ungrammatical").alias("verdict"),
        F.when(tri < high, F.when(parseable, "PCFG").otherwise("Trigram LM")).otherwise("Bigram LM").alias("method"),
    )


def share_out(total: Column, part: Column, whole: Column) -> Column:
    """The share of ``total`` that falls to ``part`` of ``whole``, rounded half to even, never under 0."""
    return F.greatest(F.lit(0), F.bround(total * (part / whole)).cast("long"))


def highlighted(text: Column, changed: Column) -> Column:
    return detokenize(F.transform(tokenize(text), lambda t, i: F.when(F.array_contains(changed, i), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)))


def add_k(n: Column, context: Column, v: Column, k: float) -> Column:
    """ln((n + k) / (context + k v)), null counts as 0."""
    zero = F.lit(0)
    return F.ln((F.coalesce(n, zero) + F.lit(float(k))) / (F.coalesce(context, zero) + F.lit(float(k)) * v))


def bucket(key: Column, seed: int, of: int) -> Column:
    """A number under ``of`` from the MD5 of 'seed:key': stable at any parallelism, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("long") % of
