"""Token sequences with labels, positions and masks, as array expressions.

Text tokens and image pads are laid out by fixed templates; every layout
returns a struct of tokens, labels, positions (offset, length) and the length
before padding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


@dataclass(frozen=True)
class Ids:
    """Special token ids; the values of a run come from its vocabulary."""

    bos: int = 1
    eos: int = 2
    boi: int = 3
    eoi: int = 4
    pad: int = 0
    img: int = 9
    boa: int = 5
    eoa: int = 6
    act: int = 8


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def times(value: int, n: Column | int) -> Column:
    """An array of n values, none for a negative n."""
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(0), n if isinstance(n, Column) else F.lit(n)).cast("int"))


def padded(tokens: Column, value: int, length: int) -> Column:
    return F.concat(tokens, times(value, length - F.size(tokens)))


def positions(*spans: tuple) -> Column:
    return F.array(*[F.struct(F.lit(a).cast("int").alias("offset") if not isinstance(a, Column) else a.cast("int").alias("offset"), F.lit(n).cast("int").alias("length")) for a, n in spans])


def _sequence(tokens: Column, labels: Column, spans: Column, ids: Ids, length: int, strict: bool = False) -> Column:
    """strict fails on a sequence longer than length; else it stays longer, without padding."""
    if strict:
        kept = lambda c: F.when(F.size(tokens) <= length, c).otherwise(F.raise_error(F.concat(F.lit("sequence longer than "), F.lit(str(length)), F.lit(": "), F.size(tokens).cast("string"))))
        return F.struct(padded(kept(tokens), ids.pad, length).alias("tokens"), padded(labels, IGNORE, length).alias("labels"), spans.alias("positions"), F.size(tokens).alias("used"))
    return F.struct(padded(tokens, ids.pad, length).alias("tokens"), padded(labels, IGNORE, length).alias("labels"), spans.alias("positions"), F.size(tokens).alias("used"))


def generation(text: Column, n_image: int, length: int, ids: Ids = Ids(), system: tuple = ()) -> Column:
    """begin, text, image, end; nothing is learned as text.

    system: the tokens before the text (of two parts) and after it; then the
    marks are labels and the text has an end of its own.
    """
    if system:
        before, behind = ints(*system[0], *system[1]), ints(*system[2])
        head, tail = F.concat(ints(ids.bos), before, text, ints(ids.eos), behind), ints(ids.eoi, ids.eos)
        labels = F.concat(ints(ids.bos), times(IGNORE, F.size(before) + F.size(text)), ints(ids.eos), times(IGNORE, F.size(behind)), ints(ids.boi), times(IGNORE, n_image), tail)
        # The position counts all system tokens and two marks, as if the text's own end were not there.
        offset = F.lit(3 + sum(map(len, system))) + F.size(text)
        return _sequence(F.concat(head, ints(ids.boi), times(ids.img, n_image), tail), labels, positions((offset, n_image)), ids, length)
    tokens = F.concat(ints(ids.bos), text, ints(ids.boi), times(ids.img, n_image), ints(ids.eoi, ids.eos))
    return _sequence(tokens, F.transform(tokens, lambda t: F.lit(IGNORE)), positions((F.size(text) + 2, n_image)), ids, length)


def understanding(text: Column, n_image: int, length: int, ids: Ids = Ids()) -> Column:
    """begin, image, text, end; all but the image is learned."""
    head, tail = ints(ids.bos, ids.boi), F.concat(ints(ids.eoi), text, ints(ids.eos))
    return _sequence(F.concat(head, times(ids.img, n_image), tail), F.concat(head, times(IGNORE, n_image), tail), positions((2, n_image)), ids, length)


def observation_future(text: Column, n_image: int, length: int, ids: Ids = Ids()) -> Column:
    """begin, observation, text, future image, end; only the future image and the end are learned."""
    head = F.concat(ints(ids.bos, ids.boi), times(ids.img, n_image), ints(ids.eoi), text)
    future = F.concat(ints(ids.boi), times(ids.img, n_image), ints(ids.eoi, ids.eos))
    learned = F.concat(times(IGNORE, F.size(head)), future)
    return _sequence(F.concat(head, future), learned, positions((2, n_image), (F.size(head) + 1, n_image)), ids, length, strict=True)


def with_actions(text: Column, n_image: int, n_action: int, length: int, ids: Ids = Ids()) -> Column:
    """As observation_future, with a block of action pads between the future image and the end."""
    head = F.concat(ints(ids.bos, ids.boi), times(ids.img, n_image), ints(ids.eoi), text)
    future = F.concat(ints(ids.boi), times(ids.img, n_image), ints(ids.eoi))
    block = F.concat(ints(ids.boa), times(ids.act, n_action), ints(ids.eoa))
    tokens = F.concat(head, future, block, ints(ids.eos))
    labels = F.concat(times(IGNORE, F.size(head)), future, times(IGNORE, n_action + 2), ints(ids.eos))
    start = F.size(head) + F.size(future) + 1
    return _sequence(tokens, labels, positions((2, n_image), (F.size(head) + 1, n_image), (start, n_action)), ids, length, strict=True)


def masks(tokens: Column, ids: Ids = Ids()) -> Column:
    """Text, image and action masks of a padded sequence."""
    mark = lambda f: F.transform(tokens, lambda t: f(t).cast("int"))
    return F.struct(mark(lambda t: ~t.isin(ids.img, ids.pad, ids.act)).alias("text_mask"), mark(lambda t: t == ids.img).alias("image_mask"), mark(lambda t: t == ids.act).alias("action_mask"))


def clear_span(mask: Column, offset: Column, length: Column) -> Column:
    """Zeroes from one before offset (the time token) to the span's end."""
    return F.transform(mask, lambda m, i: F.when((i >= offset - 1) & (i < offset + length), F.lit(0)).otherwise(m))


def text_budget(length: int, n_images: int, n_image: int, extra: int = 0) -> int:
    """Text tokens that fit beside the images with their two marks each, two marks of the sequence, and extra."""
    return length - (2 + n_images * (n_image + 2) + extra)


def rounded_up(length: Column, step: int = 128) -> Column:
    return (F.ceil(length / F.lit(step)) * step).cast("int")


def image_block(n_image: int, ids: Ids = Ids()) -> Column:
    return F.concat(ints(ids.boi), times(ids.img, n_image), ints(ids.eoi))


def inference(text: Column, n_image: int, most_text: int, ids: Ids = Ids()) -> Column:
    """A prompt's sequence for inference: begin, text, image, end, padded as if the text had most_text tokens; with its empty twin."""
    own = F.slice(text, 1, most_text)

    def of(tokens: Column) -> Column:
        whole = F.concat(ints(ids.bos), tokens, image_block(n_image, ids), ints(ids.eos), times(ids.pad, most_text - F.size(tokens)))
        return F.struct(whole.alias("tokens"), positions((F.size(tokens) + 2, n_image)).alias("positions"))

    return F.struct(of(own).alias("given"), of(ints()).alias("empty"))


def mixed_inference(text: Column, empty: Column, n_image: int, ids: Ids = Ids()) -> Column:
    """Prompt and empty prompt, open at the end, both padded to the longer one's length, a multiple of 128."""
    whole = lambda tokens: F.concat(ints(ids.bos), tokens, image_block(n_image, ids))
    length = rounded_up(F.greatest(F.size(text), F.size(empty)) + n_image + 3)
    of = lambda tokens: F.struct(F.concat(whole(tokens), times(ids.pad, length - F.size(whole(tokens)))).alias("tokens"), positions((F.size(tokens) + 2, n_image)).alias("positions"))
    return F.struct(of(text).alias("given"), of(empty).alias("empty"))


# The strings of special tokens by the language model's family.
SPECIAL = {
    "llama3": {"bos": "<|begin_of_text|>", "boi": "<|img_start|>", "eoi": "<|img_end|>", "bov": "<|vid_start|>", "eov": "<|vid_end|>", "img_pad": "<|image_pad|>", "vid_pad": "<|video_pad|>", "img": "<image>"},
    "qwen2_5": {"bos": "<|im_start|>", "boi": "<|vision_start|>", "eoi": "<|vision_end|>", "bov": "<|vid_start|>", "eov": "<|vid_end|>", "img_pad": "<|image_pad|>", "vid_pad": "<|video_pad|>", "img": "<image>"},
}
ACTION_SPECIAL = {"boa": "<|act_start|>", "eoa": "<|act_end|>", "act_pad": "<|act_pad|>"}


def special_tokens(family: str, actions: bool = False) -> dict[str, str]:
    """Names and strings of a family's special tokens; action tokens exist for one family alone."""
    if family not in SPECIAL:
        raise ValueError(f"unknown family: {family}")
    if actions and family != "qwen2_5":
        raise ValueError(f"no action tokens for {family}")
    return SPECIAL[family] | (ACTION_SPECIAL if actions else {})


def vocabulary_ids(vocabulary: dict[str, int], family: str, eos: int, actions: bool = False) -> Ids:
    """Ids from a vocabulary's token strings."""
    own = {name: vocabulary[token] for name, token in special_tokens(family, actions).items()}
    extra = {"boa": own["boa"], "eoa": own["eoa"], "act": own["act_pad"]} if actions else {}
    return Ids(bos=own["bos"], eos=eos, boi=own["boi"], eoi=own["eoi"], pad=vocabulary["[PAD]"], img=own["img_pad"], **extra)
