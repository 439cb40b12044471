"""Fixed values.

Everything in this file is data that has to be equal to the values existing
prompts, result files and reward configurations were made with: tags, prompt
texts, folder names, numeric limits.  No logic lives here.
"""

from __future__ import annotations

# --- fixed values: tags and markers -----------------------------------------
BOX_OPEN = r"\boxed{"
BOX_WORD = r"\boxed"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
ANSWER_OPEN, ANSWER_CLOSE = "<answer>", "</answer>"
DESC_OPEN = "<desc>"
IMAGE_TOKEN = "<image>"
SALVAGE_CUE = "think is over, now give the **Final Answer**"

# --- fixed values: whitespace -----------------------------------------------
# The characters a Python str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java character class, and the narrower set that the reward
# formats use for "only whitespace between the blocks".
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
WS_BLOCK = r"[\s\x85\p{Z}]"

# --- fixed values: option letters -------------------------------------------
CHOICE_LETTERS = ("A", "B", "C", "D", "E", "F")
MATHV_PLACEHOLDER_OPTIONS = "ABCDE"

# --- fixed values: data sets ------------------------------------------------
MATH_V, WE_MATH, MATHVERSE = "MATH-V", "We-Math", "MathVerse"
MATHVISTA, LOGICVISTA, DYNAMATH = "MathVista", "LogicVista", "DynaMath"
OLYMPIAD = "OlympiadBench"
UNKNOWN = "Unknown"

IMAGE_DIRS = {
    MATH_V: "MATH-V",
    WE_MATH: "We-Math/data",
    MATHVERSE: "MathVerse/images",
    MATHVISTA: "MathVista",
    LOGICVISTA: "LogicVista/data/images",
    DYNAMATH: "DynaMath/samples_and_result/10trials",
}
OLYMPIAD_IMAGE_DIR = "OlympiadBench/OlympiadBench_Dataset/images"
BENCHMARK_FILES = {
    MATHVERSE: "MathVerse/testmini.json",
    MATHVISTA: "MathVista/testmini.json",
    LOGICVISTA: "LogicVista/data/dataset.json",
    MATH_V: "MATH-V/data/test.jsonl",
    DYNAMATH: "DynaMath/samples_and_result/combined_dataset.json",
}
# Stored as one JSON object {id: record} rather than as a list of records.
KEYED_BENCHMARKS = (DYNAMATH, LOGICVISTA, MATHVISTA)
DEFAULT_ROOT = "eval/Benchmarks"
SKIPPED_FILE_MARKS = ("filtered_", "We-Math")

# --- fixed values: numbers --------------------------------------------------
DYNAMATH_IMAGES = 501
DYNAMATH_TRIALS = 10
SAVE_BATCH = 1024
MIN_PIXELS = 256 * 28 * 28
MAX_PIXELS = 1280 * 28 * 28
OLYMPIAD_MIN_PIXELS = 224 * 224
LENGTH_REWARD_TOKENS = 512

# --- fixed values: prompt texts ---------------------------------------------
SYSTEM_PROMPT_DEFAULT = (
    "let's think step by step. The final answer MUST BE put in \\boxed{}."
)
SYSTEM_PROMPT_BOXED = (
    "Let's think step by step.The final answer MUST BE put in \\boxed{}."
)
SYSTEM_PROMPT_THINK_BOXED = (
    "You FIRST think about the reasoning process as an internal monologue and "
    "then provide the final answer. The reasoning process MUST BE enclosed "
    "within <think> </think> tags. The final answer MUST BE put in \\boxed{}."
)
SYSTEM_PROMPT_THINK_ANSWER = (
    "You are a multimodal reasoner. The user asks a question, and you solve it. "
    "You need first think about the reasoning process in the mind and then "
    "provide the user with the answer. The reasoning process and answer are "
    "enclosed within <think> </think> and <answer> </answer> tags, respectively, "
    "i.e., <think> reasoning process here </think><answer> answer here </answer>"
)
MATHVISTA_OPTION_CUE = (
    "\n\nPlease select the correct answer from the following options:"
)
JUDGE_SYSTEM_PROMPT = (
    "You are an expert in evaluating reasoning processes. Your task is to "
    "determine whether the given reasoning process is correct, fluent, and "
    "complete. Please evaluate the reasoning process according to the following "
    "criteria and output the result:\n\n"
    "1: If the reasoning process is completely correct, fluent, logically clear, "
    "and completely solves the problem.\n"
    "0: If the reasoning process contains any errors, is not fluent, has logical "
    "leaps, omits steps, or fails to solve the problem correctly.\n\n"
    "The final answer should be 0 or 1 based on above rules. Output analysis "
    "before your final answer and the final answer should enclosed within "
    "\\boxed{}"
)
CAPTION_JUDGE_HEAD = "Image: "
CAPTION_JUDGE_QUESTION = "\n\nQuestion: "
CAPTION_JUDGE_TAIL = (
    "\n\nAnswer the question based on image, the final answer should be "
    "enclosed in \\boxed{}"
)
THINKING_JUDGE_QUESTION = "Question: "
THINKING_JUDGE_REASONING = "\n\nReasoning: "

# fixed values: units that may stand behind a number, after a blank
PLAIN_UNITS = "mm|cm|dm|m|km|mg|g|kg|ms|s|min|h|ml|l|N|J|W|V|A|Hz|Pa|K|mol|inches|feet|meters|seconds|minutes|hours|degrees|units"
