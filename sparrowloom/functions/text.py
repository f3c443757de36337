"""Caption, instruction and conversation clean-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Caption openings, removed in this order wherever they occur.
CAPTION_PHRASES = (
    "The image features ",
    "The image presents ",
    "The image you've sent is, ",
    "In the center of the image, ",
    "The image showcases ",
    "The image is ",
    "The image captures ",
    "In the given image ",
    "The image portrays ",
    "In the image, ",
    "In this image, we see ",
    "The image depicts ",
    "This is ",
    "In this image, ",
    "This image captures ",
    "This image showcases ",
    "This suggests ",
    "In the photo, we see ",
    "This is ",
    "This image is ",
    "In the photo, we have ",
    "The photo features ",
    "The photo depicts ",
    "The photo appears to be ",
)

IMAGE_TAG = "<image>"


def clean_caption(text: Column, phrases: tuple[str, ...] = CAPTION_PHRASES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), phrases, text)


def without_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def with_suffix_sentence(text: Column, suffix: str, strict: bool = True) -> Column:
    """Append after a full stop, or after a letter with a full stop between; other endings raise, or stay if not strict."""
    other = F.raise_error(F.concat(F.lit("unexpected end: "), text)).cast("string") if strict else text
    return F.when(F.endswith(text, F.lit(".")), F.concat(text, F.lit(suffix))).when(text.rlike(r"\p{L}\z"), F.concat(text, F.lit("."), F.lit(suffix))).otherwise(other)


def image_tag_first(text: Column) -> Column:
    """A trailing line break and image tag move to the front."""
    tail = f"\n{IMAGE_TAG}"
    return F.when(F.endswith(text, F.lit(tail)), F.concat(F.lit(f"{IMAGE_TAG}\n"), F.substring(text, F.lit(1), F.length(text) - len(tail)))).otherwise(text)


def only_image_tag(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(IMAGE_TAG)), F.lit(IMAGE_TAG)).otherwise(text)


def chat_role(role: Column) -> Column:
    return F.when(role == "human", "user").otherwise("assistant")


def with_extension(path: Column, extension: str = ".jpg") -> Column:
    return F.when(F.endswith(path, F.lit(extension)), path).otherwise(F.concat(path, F.lit(extension)))


def without_index(name: Column) -> Column:
    """Without trailing digits and the one character before them, whatever it is."""
    return F.regexp_replace(name, r".[0-9]+$", "")


def first_segment(text: Column) -> Column:
    return F.substring_index(text, " | ", 1)


def last_component(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frame_times(times: Column) -> Column:
    return F.array_join(F.transform(times, lambda t: F.format_string("%.2fs", t)), ",")


def words(text: Column, limit: int | None = None) -> Column:
    """Words between white space, a stand-in for an external tokenizer, cut to limit."""
    # With a limit the text is split no further than needed: a leading blank and the rest take a piece each.
    own = F.filter(F.split(text, r"[\x20\x09-\x0D]+", limit + 2 if limit else -1), lambda w: w != "")
    return F.slice(own, 1, limit) if limit else own


def mark_prompt(category: Column, color: Column) -> Column:
    return F.format_string("Mark all %1$s in the image with %2$s bounding box. Image with marked %1$s:", category, color)


def segment_prompt(category: Column, color: Column) -> Column:
    return F.format_string("Segment all %1$s in the image with %2$s mask. Image with segmented %1$s:", category, color)


def decoded(octets: Column) -> Column:
    return F.decode(octets, "UTF-8")


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    """Whether a name ends with one of the suffixes, as it is or without its trailing digits and the character before them."""
    short = without_index(name)
    return F.exists(F.array(*map(F.lit, suffixes)), lambda x: F.endswith(name, x) | F.endswith(short, x))
