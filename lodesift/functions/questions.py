"""What a question's words say, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no retrieval terms.
STOP_TERMS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "do", "does", "for", "from", "give", "help", "how", "i", "in", "is",
    "it", "me", "my", "of", "on", "or", "our", "please", "show", "some", "that", "the", "their", "there", "these", "this", "to", "us",
    "use", "using", "want", "what", "when", "where", "which", "who", "will", "with", "would", "you", "your", "find", "relevant",
    "sources", "about", "am", "ask", "know", "knows", "list", "tell", "need",
)
#: Words that mark a Spanish question.
SPANISH = ("dónde", "donde", "cómo", "qué", "cuál", "cuáles", "quién", "sobre", "para", "los", "las", "una", "del", "encuentro", "documentación", "fuentes", "está", "están")
#: More words without content in a Spanish question.
SPANISH_FUNCTION = ("de", "la", "el", "en", "un", "y", "o", "e", "que", "con", "por", "al", "es", "son", "se", "su", "sus", "lo", "más", "como", "busco", "buscar", "encontrar", "hay")
#: Fixed value: questions of more bytes are searched as they are.
LONGEST = 2_000


def words(question: Column) -> Column:
    """The words of a question without the punctuation around them."""
    bare = F.transform(F.split(F.coalesce(question, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def retrieval_terms(question: Column) -> Column:
    """Distinct terms in order: runs of letters, digits and `-_.` in lower case, of two bytes or more, not stop words."""
    runs = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([\p{L}\p{N}._-]+)"), F.lit(1))
    terms = F.transform(runs, lambda w: F.lower(F.regexp_replace(w, r"^[._-]+|[._-]+$", "")))
    return F.array_distinct(F.filter(terms, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_TERMS)))


def non_english(question: Column) -> Column:
    """Whether a question has an opening Spanish mark or two marker words, repeats included."""
    marks = F.filter(words(question), lambda w: F.lower(w).isin(*SPANISH))
    return F.coalesce(question.rlike("[¿¡]"), F.lit(False)) | (F.size(marks) >= 2)


def technical(word: Column) -> Column:
    """A word with an inner symbol, an inner capital, or both digits and letters."""
    return word.rlike(r"[\p{L}\p{N}][-_./:+#][\p{L}\p{N}]|^.+\p{Lu}") | (word.rlike("[0-9]") & word.rlike(r"\p{L}"))


def pure_number(word: Column) -> Column:
    return word.rlike(r"^[0-9.,]*[0-9][0-9.,]*$")


def capitalized(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}.*\p{Ll}")


def natural_only(question: Column) -> Column:
    """Whether a question is too long for variants."""
    return F.octet_length(F.coalesce(question, F.lit(""))) > LONGEST
