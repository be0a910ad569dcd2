"""Deterministic answers of the right shape per prompt, for tests without a model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable


def demo_generator(prompt: str, source: str) -> str:
    """Fixed answers of the right shape per prompt id, for tests without a model."""
    shape = _DEMO.get(prompt)
    return shape(source) if shape else f"# {prompt}\n\n{' '.join(source.split())[:520]}"


def _demo_analysis(source: str) -> str:
    cited = re.findall(r"content_[0-9a-f]{8,40}", source)
    body = source.rsplit("\n", 1)[-1].strip() or "演示"
    item = {"text": body, "source_content_indexes": cited[-1:]}
    return json.dumps(
        {
            "chapter_title": "演示章节",
            "chapter_theme": "演示主题",
            "subtopics": [{"title": "演示子主题", "definitions": [], "quotes": [item], "viewpoints": [{**item, "arguments": [item], "case": None}]}],
        },
        ensure_ascii=False,
    )


def _demo_modules(source: str) -> str:
    keys = list(dict.fromkeys(re.findall(r"CHAPTER_\d{3}", source)))
    groups = [keys[i : i + 3] for i in range(0, len(keys), 3)]
    lines = []
    for n, group in enumerate(groups, start=1):
        named = "、".join(f"[{k}]" for k in group)
        lines.append(f"## 模块{n}：演示模块{n}\n听众问题：演示问题{n}\n来源章节：{named}\n建议声音数：{min(4, len(group) + 1)}")
    return "\n\n".join(lines)


def _demo_outline(source: str) -> str:
    keys = list(dict.fromkeys(re.findall(r"CHAPTER_\d{3}", source))) or ["CHAPTER_001"]
    asked = re.search(r"集数[：:]\s*(\d+)", source)
    count = int(asked.group(1)) if asked else min(3, len(keys))
    return "\n\n".join(
        f"## 第{n}集：演示声音{n}\n听众钩子：演示钩子\n核心主题：演示主题\n核心要点：\n1. 要点一；\n2. 要点二。\n内容类型：解读\n来源章节：[{keys[(n - 1) % len(keys)]}]"
        for n in range(1, count + 1)
    )


def _demo_match(source: str) -> str:
    ids = list(dict.fromkeys(re.findall(r"knowledge_[0-9a-f]{24}", source)))
    return json.dumps({"knowledge_item_ids": ids[:8]})


_DEMO: dict[str, Callable[[str], str]] = {
    "book_analysis": _demo_analysis,
    "chapter_compression": lambda source: source,
    "json_repair": lambda source: source,
    "album_module_plan": _demo_modules,
    "album_outline": _demo_outline,
    "episode_source_match": _demo_match,
    "character_relationships": lambda source: json.dumps(
        {"relationships": [{"characters": ["甲", "乙"], "relationship": "演示关系", "evidence": "演示依据"}]}, ensure_ascii=False
    ),
}
