"""Declared schemas: inputs are never read by inference."""

from __future__ import annotations

from .functions import fixed as K

BENCHMARK_SCHEMAS = {
    K.MATH_V: "id string, question string, options array<string>, image string, answer string",
    K.WE_MATH: "question string, option string, image_path string, answer string",
    K.MATHVERSE: "question_for_eval string, image string, answer string",
    K.MATHVISTA: "question string, choices array<string>, image string, answer string",
    K.LOGICVISTA: "question string, imagename string, answer string",
    K.DYNAMATH: "question string, image string, answer string",
    K.OLYMPIAD: "`from` string, context string, question string",
}

# Every column any benchmark uses; a benchmark lacks some, which then are NULL.
BENCHMARK_COLUMNS = {
    "question": "string",
    "question_for_eval": "string",
    "options": "array<string>",
    "choices": "array<string>",
    "option": "string",
    "image": "string",
    "image_path": "string",
    "imagename": "string",
    "from": "string",
    "context": "string",
}

RESPONSES = (
    "question string, choices array<string>, image string, answer string, "
    "resp string, parsed_answer string, verify boolean"
)
