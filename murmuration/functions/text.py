"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Accented Latin letters and what they fold to (fixed values, in order).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normal(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscore to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def folded(text: Column) -> Column:
    """normal(), with accents dropped."""
    return normal(F.translate(text, ACCENTED, FOLDED))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column, least_letters: int = 1) -> Column:
    """Lower-case runs of letters of at least so many letters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\p{{L}}{{{least_letters},}}"), F.lit(0))


def word_shingles(text: Column, n: int = 3) -> Column:
    """n-grams of the words of normalised text; of fewer words, the words themselves."""
    words = F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
    # zipped shifts keep it linear: inside a lambda the words would be split again for every place
    grams = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - (n - 1)))
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(j + 1), F.greatest(F.lit(0), F.size(words) - (n - 1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) >= n, grams).otherwise(words)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def caps_ratio(text: Column) -> Column:
    """Capitals among the letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def hashtags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def leading_mention(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*@([\p{L}\p{N}_.]+)", 1), F.lit(""))


def snippet(text: Column, word: Column, before: int = 10, after: int = 30) -> Column:
    at = F.locate(word, F.lower(text)) if isinstance(word, str) else F.instr(F.lower(text), word)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(word) + after))


def title(text: Column, most: int = 100) -> Column:
    """The first sentence if it is short, else the beginning."""
    first = F.regexp_extract(F.trim(text), r"^[^.!?\n]+", 0)
    return F.when(F.length(first).between(1, 119), first).otherwise(F.substring(F.trim(text), 1, most))


def clean_url(url: Column) -> Column:
    """Without fragment and query, but for a story id; without a slash at the end."""
    story = F.regexp_extract(url, r"[?&]((?:story_fbid|fbid|v)=[^&#]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"/+$", "")
    return F.when(F.length(story) > 0, F.concat(bare, F.lit("?"), story)).otherwise(bare)


def post_type(url: Column) -> Column:
    u = F.lower(url)
    return F.when(F.contains(u, F.lit("/reel")), "reel").when(F.contains(u, F.lit("/video")) | F.contains(u, F.lit("/watch")), "video").when(F.contains(u, F.lit("/photo")), "photo").otherwise("post")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, ACCENTED, FOLDED)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_name(name: Column) -> Column:
    """First line, without marks around it, times, and repeated blanks."""
    n = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\r\n].*$", "")
    n = F.regexp_replace(n, r"\s*[·•|].*$", "")
    return F.trim(F.regexp_replace(n, r"\s+", " "))
