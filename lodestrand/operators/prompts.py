"""Prompt assembly for multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the closing instruction.
INSTRUCTION = "Answer with the letter of the best option only."


def span_line(label: Column, start: Column, end: Column, speech: Column, screen: Column) -> Column:
    """One span of a window: its times, what is said and what is on screen, absent parts left out."""
    from lodestrand.functions.strings import mmss

    said = F.when(F.length(F.trim(speech)) > 0, F.concat(F.lit("Speech: "), speech))
    shown = F.when(F.length(F.trim(screen)) > 0, F.concat(F.lit("On screen: "), screen))
    return F.concat_ws("\n", F.concat_ws(" ", F.concat(label, F.lit(":")), mmss(start), F.lit("-"), mmss(end)), said, shown)


def mcq_prompt(question: Column, options: Column, spans: Column, transcript: Column, n_frames: Column) -> Column:
    """Blocks with blank lines between: frames, transcript, spans, question, options, instruction; empty ones go."""
    frames = F.when(n_frames > 0, F.format_string("The first %d images are spread over the whole video.", n_frames))
    told = F.when(F.length(F.trim(transcript)) > 0, F.concat(F.lit("Transcript: "), transcript))
    shown = F.when(F.size(spans) > 0, F.array_join(spans, "\n"))
    return F.concat_ws("\n\n", frames, told, shown, F.concat(F.lit("Question: "), question), F.array_join(options, "\n"), F.lit(INSTRUCTION))
