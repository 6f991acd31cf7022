"""Language identification by compression.

For each language a raw-content dictionary for zstandard is put together from labelled texts.  The
whole text, in lower case and with blanks for digits and marks, is encoded slice by slice with every
dictionary; the language whose dictionary gives the fewest bytes in sum is chosen, and rejected if
the next one is within `LEAST_MARGIN` of it.  Slices are short, so a text is measured against the
dictionaries rather than against itself, and a passage counts by its length.

Training reads at most `SAMPLE_TEXTS` texts a language, those with the smallest hashes, and keeps
at most `DICTIONARY_BYTES` of each language: both are parameters of the fit, not of the corpus.
A language with less labelled text has its own text repeated up to the length of the others.

Defined cases: a text that is null or has no letter is `und`, score 0 and rejected; ties go to the
first language in code-point order; repeated rows get equal results; without training rows every
text is `und`; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import add_columns, hash_sample, map_columns, with_key

SAMPLE_TEXTS = 400
DICTIONARY_BYTES = 16 * 1024
PASSAGE_WORDS = 25
CLEANINGS = 2
SHARE_BYTES = 600  # the most that one training text gives to a dictionary, so that no copy of one text decides
SLICE = 1536
LEVEL = 12
LEAST_MARGIN = 0.002
FULL_MARGIN = 0.15
UNKNOWN = "und"

# Bytes of a text that are looked at: letters of ASCII, and whatever is beyond it.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_COMPRESSORS: dict[int, list] = {}


class Model(NamedTuple):
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def normal(text: str) -> bytes:
    """The whole text in lower case; marks and digits say nothing about the language and become single blanks."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def sample(docs: DataFrame, usable: Column, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(lang, text): about the `texts` labelled texts of each language whose hashes are smallest."""
    rows = with_key(docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))).select("lang", "text", F.xxhash64("_id", "_k").alias("h"))
    return hash_sample(rows, "lang", F.col("h"), texts).select("lang", "text", "h")


def fit(docs: DataFrame, usable: Column | None = None, texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries of the passages of the sampled texts, without doubtful ones.

    Doubtful is a passage that the dictionaries of the other half of the sample give to another
    language: a wrong label, or a quotation or notice in another language.
    """
    drawn = sample(docs, F.lit(True) if usable is None else usable, texts)
    # Passages are cut where the texts lie; what reaches the driver is bounded by the parameters.
    cut_up = lambda lang, text, h: list(zip(*((a, i, n, p) for a, t, i in zip(lang, text, h) for n, p in enumerate(_passages(t))))) or [[]] * 4
    rows = sorted(map(tuple, map_columns(drawn, cut_up, "lang string, h bigint, n int, passage string").collect()))
    passages = [(lang, p, h & 1) for lang, h, _, p in rows]
    for _ in range(CLEANINGS):
        halves = [_build([x for x in passages if x[2] == side], dictionary_bytes) for side in (0, 1)]
        known = set(halves[0].languages) & set(halves[1].languages)
        passages = [x for x in passages if x[0] not in known or classify(x[1], halves[1 - x[2]])[0] == x[0]]
    return _build(passages, dictionary_bytes)


def _passages(text: str) -> list[str]:
    """Evenly spread passages of a text, `SHARE_BYTES` in sum at most."""
    words = text.split()
    parts = [" ".join(words[i : i + PASSAGE_WORDS])[:SHARE_BYTES] for i in range(0, len(words), PASSAGE_WORDS)]
    return parts[:: max(1, -(-len(parts) * PASSAGE_WORDS * 6 // SHARE_BYTES))]


def _build(rows: list[tuple[str, str, int]], dictionary_bytes: int) -> Model:
    parts: dict[str, list[bytes]] = {}
    for lang, text, _ in rows:
        parts.setdefault(lang, []).append(normal(text) + b" ")
    # Dictionaries of one length: that of the longest, a shorter one is repeated, so nothing of any language is left out.
    raw = {lang: b"".join(p) for lang, p in parts.items()}
    size = min(dictionary_bytes, max(map(len, raw.values()), default=0))
    languages = tuple(sorted(raw))
    return Model(languages, tuple((raw[x] * -(-size // len(raw[x])))[:size] for x in languages))


def _compressors(model: Model) -> list:
    import zstandard

    key = hash(model)
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(model.dictionaries[0]), source_size=SLICE, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        built = []
        for raw in model.dictionaries:
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            built.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
        _COMPRESSORS[key] = built
    return _COMPRESSORS[key]


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    data = normal(text)
    slices = [data[i : i + SLICE] for i in range(0, len(data), SLICE)]
    sizes = [sum(len(c.compress(s)) for s in slices) for c in _compressors(model)]
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    first = sizes[order[0]]
    margin = 1.0 if len(order) == 1 else (sizes[order[1]] - first) / max(1, sizes[order[1]])
    return model.languages[order[0]], min(1.0, margin / FULL_MARGIN), margin < LEAST_MARGIN


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with lang_pred, score and rejected; other columns stay."""
    return add_columns(docs, ["text"], lambda texts: list(zip(*(classify(t, model) for t in texts))), "lang_pred string, score double, rejected boolean")
