"""gradeframe: grade model answers on Spark."""

from .functions.choices import with_choice_match
from .functions.equivalence import equivalent, final_answer, parse_answer
from .functions.prompts import build_prompt
from .functions.rewards import REWARDS, register_reward, score
from .operators.evaluate import evaluate_responses, judge_standard, judge_trials

__all__ = [
    "REWARDS",
    "build_prompt",
    "equivalent",
    "evaluate_responses",
    "final_answer",
    "judge_standard",
    "judge_trials",
    "parse_answer",
    "register_reward",
    "score",
    "with_choice_match",
]
