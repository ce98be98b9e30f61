"""Prompt texts, as Catalyst expressions. The wording is this engine's own; parts, order and limits are what callers rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a difference that an update prompt shows; the answer that means a page is current.
MAX_DIFF, NO_CHANGES = 50_000, "NO_CHANGES_NEEDED"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def bullet_list(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(none))


def scale_guidance(files: Column) -> Column:
    return (
        F.when(files <= 5, "- Very small repository: one Overview section of 1-2 pages, no more sections.")
        .when(files <= 20, "- Small repository: 1-3 sections of 1-2 pages each.")
        .when(files <= 50, "- 2-5 sections of 1-3 pages each.")
        .otherwise("- 3-7 sections of 1-4 pages each.")
    )


def outline_prompt(name: Column, tree: Column, readme: Column, files: Column, languages: Column) -> Column:
    return _text(
        "Plan a documentation wiki for a repository.\n\n## Repository: ", name, "\n\n### Files (", files.cast("string"), ")\n```\n", tree, "\n```\n\n",
        F.when(F.coalesce(readme, F.lit("")) != "", _text("### README (intent, not truth)\n", readme, "\n\n")).otherwise(""),
        "### Languages\n", F.array_join(languages, ", "), "\n\n## Rules\n", scale_guidance(files),
        "\n- The first section is Overview; its pages name entry points, not only documents.\n- Answer with the JSON object of title, description and sections alone.",
    )


def diagram_section(kinds: Column) -> Column:
    return F.when(F.size(kinds) > 0, _text("## Diagrams\n\nOptional; one at most, two on pages of several components. Suggested: ", F.array_join(kinds, ", "), ".\nUse fenced mermaid blocks with quoted labels.\n\n")).otherwise("")


def _output(final_message: bool, update: bool) -> str:
    if final_message:
        return f"\n\n## Output\nThe last message is the page's Markdown alone{', or ' + NO_CHANGES + ' if nothing changes' if update else ''}."
    return '\n\n## Output\nSet "noChangesNeeded", or "content" to the whole page.' if update else ""


def page_prompt(name: Column, section: Column, title: Column, description: Column, seeds: Column, diagrams: Column, outline: Column, final_message: bool = False) -> Column:
    return _text(
        "Write a documentation page for the repository ", name, ".\n\n## Wiki structure\n", outline, "\n\n## Page\n- Section: ", section, "\n- Page: ", title, "\n- About: ", description,
        "\n\n## Files to start from\n", bullet_list(seeds, "- (none: find the relevant files)"), "\n\n", diagram_section(diagrams), "## Form\nMarkdown from second level headings on; headings are about the code; the title is added elsewhere.", _output(final_message, False),
    )


def update_prompt(name: Column, change: Column, about: Column, diff: Column, title: Column, content: Column, seeds: Column, outline: Column, final_message: bool = False) -> Column:
    return _text(
        "Bring a page of the wiki of ", name, " up to date.\n\n## Wiki structure\n", outline, "\n\n## Change\n- ", change, "\n- ", about, "\n\n```diff\n", F.left(diff, F.lit(MAX_DIFF)), "\n```\n\n## Page: ", title, "\n\n", content,
        "\n\n## Its files\n", bullet_list(seeds, "- (none recorded: see the difference)"), _output(final_message, True),
    )


def with_system(prompt: Column, system: Column) -> Column:
    return F.when(F.coalesce(system, F.lit("")) == "", prompt).otherwise(_text("System instructions:\n", system, "\n\nUser request:\n", prompt))
