"""Chat messages, flat chat texts, assistant positions and label masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrid.functions.fields import strip
from mossgrid.functions.tasks import instruction

# Marks of the flat chat format.
IMAGE_MARK = "<|vision_start|><|image_pad|><|vision_end|>"
ASSISTANT_MARKS = ["<|im_start|>assistant\n", "<|im_start|>assistant", "assistant\n", "assistant:"]
IGNORED = -100

PART = "struct<type:string,text:string,image:string>"


def full_question(name: Column, question: Column, *, training: bool = False, n_images: Column | None = None) -> Column:
    """Instruction, an empty line, and the trimmed question."""
    return F.concat(instruction(name, training=training, n_images=n_images), F.lit("\n\n"), strip(question))


def _text(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image")).cast(PART)


def _images(images: Column) -> Column:
    return F.transform(
        F.coalesce(images, F.array().cast("array<string>")),
        lambda p: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), p.alias("image")).cast(PART),
    )


def messages(images: Column, text: Column, answer: Column | None = None) -> Column:
    """User message with the images before the text; with an answer, the assistant's too."""
    user = F.struct(F.lit("user").alias("role"), F.concat(_images(images), F.array(_text(text))).alias("content"))
    if answer is None:
        return F.array(user)
    return F.array(user, F.struct(F.lit("assistant").alias("role"), F.array(_text(answer)).alias("content")))


def flat_chat(n_images: Column, text: Column, answer: Column) -> Column:
    """The chat as one text, with at least one image mark."""
    marks = F.repeat(F.lit(IMAGE_MARK), F.greatest(F.lit(1), n_images).cast("int"))
    return F.concat(
        F.lit("<|im_start|>user\n"), marks, text, F.lit("<|im_end|>\n<|im_start|>assistant\n"), F.coalesce(answer, F.lit("")), F.lit("<|im_end|>")
    )


def assistant_start(text: Column) -> Column:
    """Characters before the assistant's words: behind the first mark of the list that
    occurs, else the whole length."""
    ends = [F.when(F.locate(m, text) > 0, F.locate(m, text) - 1 + len(m)) for m in ASSISTANT_MARKS]
    return F.coalesce(*ends, F.length(text))


def masked_labels(ids: Column, prefix: Column, pad: int) -> Column:
    """Token ids with the prefix and all padding ignored."""
    hidden = F.transform(F.slice(ids, 1, F.greatest(prefix, F.lit(0))), lambda t: F.lit(IGNORED))
    shown = F.slice(ids, F.greatest(prefix, F.lit(0)) + 1, F.greatest(F.size(ids), F.lit(0)))
    return F.concat(hidden, F.transform(shown, lambda t: F.when(t == pad, F.lit(IGNORED)).otherwise(t)))


def learning_ratio(labels: Column) -> Column:
    """Share of the labels that aren't ignored; null for none."""
    return F.try_divide(F.size(F.filter(labels, lambda t: t != IGNORED)), F.size(labels))


def capped_images(images: Column, most: int) -> Column:
    """The first images of a sample; all for zero."""
    return F.slice(images, 1, most) if most > 0 else images


def training_steps(n: Column, epochs: int, batch: int, accumulated: int) -> Column:
    """Whole optimiser steps of a run."""
    return F.floor(n * epochs / (batch * accumulated))


def logging_step(steps: Column) -> Column:
    return F.greatest(F.lit(10), F.floor(steps / 100))


def image_tokens(ids: Column, image_id: int) -> Column:
    """Image tokens among the ids of a row."""
    return F.size(F.filter(ids, lambda t: t == image_id))


def batch_check(ids: Column, n_images: Column, n_texts: Column, image_id: int) -> Column:
    """What may be wrong with a batch: no ids, another number of images than of texts; and the
    image tokens of its ids."""
    return F.struct(
        ids.isNull().alias("no_ids"), (n_images != n_texts).alias("mismatch"), F.coalesce(image_tokens(ids, image_id), F.lit(0)).alias("image_tokens")
    )


def error_rate(errors: Column, batches: Column) -> Column:
    """Failed batches in percent; null before the first."""
    return F.try_divide(errors * 100.0, batches)


def hit_rate(hits: Column, misses: Column) -> Column:
    """Share of look-ups that a cache answered; null before the first."""
    return F.try_divide(hits.cast("double"), hits + misses)
