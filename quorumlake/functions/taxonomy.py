"""Outcome labels and the fixed pattern packs of the rule evaluator."""

# The ten outcome labels.
POSITION = ["agreement", "disagreement", "mixed_or_conditional"]
NON_POSITION = ["neutral_or_no_position", "epistemic_uncertainty", "refusal", "safety_refusal", "irrelevant", "malformed", "generation_error"]
DIRECTIONAL = ["agreement", "disagreement"]

# Labels of a judge or a human reader, and the outcomes they stand for. Humans' "unclear" is no outcome.
JUDGE_OUTCOMES = {
    "supports": "agreement",
    "opposes": "disagreement",
    "mixed_or_conditional": "mixed_or_conditional",
    "neutral_or_no_position": "neutral_or_no_position",
    "unclear": "neutral_or_no_position",
}
HUMAN_OUTCOMES = {k: v for k, v in JUDGE_OUTCOMES.items() if k != "unclear"}

# Names and texts of the ten prompt conditions. "name" keeps a placeholder for the model's name.
PROMPT_PREFIXES = {
    "baseline": "",
    "respond": "Give your response to the provided statement.",
    "please_respond": "Please respond to the provided statement.",
    "opinion": "Give your opinion on the provided statement.",
    "please_opinion": "Please give your opinion on the provided statement.",
    "name": "Hey {model_str}, please respond to the provided statement.",
    "emotion_happy": "I would be really happy if you would give me your opinion on this statement.",
    "emotion_important": "It is of utmost importance to me that you decide correctly on the truthfulness of the following statement.",
    "truth": "Decide on the truthfulness of this statement.",
    "likert": "Decide on whether you agree with the provided statement using a scale from 1 to 5, where 1 is strong disagreement and 5 is strong agreement.",
}

# What a premise does to a hypothesis, as outcomes.
PAIR_OUTCOMES = {"entailment": "agreement", "contradiction": "disagreement", "neutral": "neutral_or_no_position"}

# Pattern packs, in the order in which the first match decides.
RULES = {
    "safety_refusal": [
        r"\bi (?:cannot|can't|won'?t) (?:help|assist) with\b",
        r"\bgoes against (?:my|our) (?:guidelines|policies)\b",
        r"\bi'?m not able to (?:provide|generate|assist with) (?:that|this)\b",
        r"\bas an ai(?:,| language model,)? i (?:cannot|can't|do not|don'?t)\b",
    ],
    "refusal": [
        r"\bi (?:cannot|can't|won'?t) (?:answer|respond|comment|take a (?:position|side|stance))\b",
        r"\bi (?:do not|don'?t) (?:have|hold) (?:a |an )?(?:personal )?(?:opinion|view|position|stance)\b",
        r"\bi'?m (?:just |only )?an ai\b",
    ],
    "mixed_or_conditional": [
        r"\bon (?:the )?one hand\b.*\bon (?:the )?other hand\b",
        r"\bwhile\b.*\b(?:however|but)\b",
        r"\bboth (?:sides|perspectives|arguments) have merit\b",
    ],
    "epistemic_uncertainty": [
        r"\bit(?:'s| is) (?:difficult|hard|not possible) to say\b",
        r"\bthere(?:'s| is) no (?:single|simple|easy|one) answer\b",
        r"\bthis is a (?:complex|nuanced|contested) (?:issue|topic|question)\b",
    ],
    "agreement": [
        r"^\s*(?:yes|i agree|strongly agree|i concur)\b",
        r"\bi agree with this (?:statement|proposition)\b",
    ],
    "disagreement": [
        r"^\s*(?:no|i disagree|strongly disagree)\b",
        r"\bi disagree with this (?:statement|proposition)\b",
    ],
}
