"""Extraction prompts by id: one an active domain, its text made from the domain's field lists."""

from __future__ import annotations

from dataclasses import dataclass

from . import registry
from . import vocab as V


@dataclass(frozen=True)
class Prompt:
    prompt_id: str
    domain: str
    template: str

    def render(self, text: str) -> str:
        """The prompt for a document's text; braces in the text stay as they are."""
        return self.template.replace("{parsed_text}", text)


def _kind(name: str) -> str:
    return "list of strings" if name in V.LISTS else "boolean" if name in V.BOOLEANS else "integer" if name in V.NUMBERS else "string"


def _template(domain: registry.Domain) -> str:
    named = domain.key.replace("_", " ")
    shown = [f"- {n} ({_kind(n)}, {'required' if n in domain.required else 'optional'})" for n in domain.fields]
    return "\n".join([f"Read the {named} below and answer with one JSON object that has these fields:", "", *shown, "", "Give null where the text doesn't state a value. Dates are YYYY-MM-DD.", "", "Text:", "{parsed_text}"])


PROMPTS = {d.prompt: Prompt(d.prompt, d.key, _template(d)) for d in registry.DOMAINS.values() if d.active and d.prompt}


def prompt(prompt_id: str) -> Prompt:
    if prompt_id not in PROMPTS:
        raise KeyError(f"{prompt_id!r}; known: {ids()}")
    return PROMPTS[prompt_id]


def ids() -> list[str]:
    return sorted(PROMPTS)


def for_domain(key: str) -> Prompt:
    """A domain's prompt; an unknown domain or a planned one raises."""
    return prompt(registry.require_active(key, "prompt selection").prompt)
