"""Rules of the languages: how their sources name other files and declare symbols.

Fixed values, in the order of the languages; ``extract`` runs them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A pattern whose group names targets by stem, path or dotted name.

    ``each`` takes every name out of what the group holds, for lists; ``skip`` are names that are
    none, and ``rel_if`` gives names that match a pattern another kind.
    """

    exts: tuple[str, ...]
    rel: str
    pattern: str
    group: int = 1
    how: str = "stem"  # see ``extract.path_candidates`` and ``extract.name_parts``
    targets: tuple[str, ...] = ()  # extensions of targets; the rule's own where empty
    each: str = ""
    skip: tuple[str, ...] = ()
    rel_if: tuple[tuple[str, str], ...] = ()


JS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue")
STYLES = (".scss", ".css", ".sass")
PAGES = (".html", ".htm", ".vue")
PY, JAVA, RUST, KOTLIN, PHP, DART = (".py",), (".java",), (".rs",), (".kt", ".kts"), (".php",), (".dart",)
CPP = (".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hxx")
CSHARP, RAZOR = (".cs",), (".razor", ".cshtml")
NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
MIXIN = ((r"(?i)(?:Mixin|Extension)$", "ExtensionMethod"),)

RULES = [
    # JavaScript and TypeScript
    Rule(JS, "Import", r"(?:import|export)\s+(?:[^'\"\n]*?\s+from\s+)?['\"]([^'\"]+)['\"]", how="path"),
    Rule(JS, "Import", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", how="path"),
    Rule(JS, "DynamicImport", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)", how="path"),
    Rule(JS, "ComponentUsage", r"<([A-Z][A-Za-z0-9_]*)", how="sibling"),
    Rule(JS, "Template", r"templateUrl\s*:\s*['\"]([^'\"]+)['\"]", how="path"),
    Rule(JS, "Style", r"styleUrls\s*:\s*\[([^\]]*)\]", how="path", each=r"['\"]([^'\"]+\.(?:css|scss|sass))['\"]"),
    Rule(JS, "Style", r"styleUrl\s*:\s*['\"]([^'\"]+)['\"]", how="path"),
    Rule(JS, "Decorator", r"@([A-Za-z0-9_]+)"),
    Rule(JS, "Decorator", r"@[A-Za-z0-9_]+\(([^)]*)\)", each=r"([A-Z][A-Za-z0-9_]+)"),
    Rule(JS, "Interface", r"implements\s+([A-Za-z0-9_,\s]+)", each=NAME),
    Rule(STYLES, "StyleReference", r"@(?:import|use|forward)\s+['\"]([^'\"]+)['\"]", how="path"),
    Rule(PAGES, "ScriptReference", r"<script[^>]*\bsrc=['\"]([^'\"]+)['\"]", how="path"),
    Rule(PAGES, "StyleReference", r"<link[^>]*\bhref=['\"]([^'\"]+)['\"]", how="path"),
    # Python
    Rule(PY, "Import", r"(?m)^\s*from\s+(\.+[A-Za-z0-9_.]*)\s+import", how="dots"),
    Rule(PY, "Import", r"(?m)^\s*from\s+([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)\s+import", how="module"),
    Rule(PY, "Import", r"(?m)^\s*import\s+([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)", how="module", rel_if=((r"(?i)ext", "ExtensionMethod"),)),
    Rule(PY, "BaseType", r"(?m)^\s*class\s+[A-Za-z0-9_]+\s*\(([^)]+)\)\s*:", how="module", each=r"([A-Za-z0-9_.]+)", rel_if=MIXIN),
    Rule(PY, "Decorator", r"@(?:[A-Za-z0-9_]+\.)*([A-Za-z0-9_]+)", how="module", skip=("property", "classmethod", "staticmethod", "abstractmethod", "override")),
    Rule(PY, "EventType", r"@[A-Za-z0-9_.]+\(([^)]*)\)", how="module", each=r"(?:sender|model)\s*=\s*([A-Za-z0-9_]+)"),
    # Java
    Rule(JAVA, "Import", r"(?m)^\s*import\s+([A-Za-z0-9_.]+);"),
    Rule(JAVA, "ExtensionMethod", r"(?m)^\s*import\s+static\s+([A-Za-z0-9_.]+);"),
    Rule(JAVA, "ExtensionMethod", r"@ExtensionMethod\s*\(([^)]*)\)", each=r"([A-Za-z0-9_]+)\.class"),
    Rule(JAVA, "MethodCall", r"([A-Z][A-Za-z0-9_]+)\.[a-z][A-Za-z0-9_]*\s*\(", rel_if=((r"(?:Extensions?|Utils|Helper)$", "ExtensionMethod"),)),
    Rule(JAVA, "Interface", r"implements\s+([A-Za-z0-9_,\s]+)", each=NAME),
    Rule(JAVA, "EventType", r"@(?:EventListener|TransactionalEventListener|KafkaListener|RabbitListener)\s*\(\s*(?:value\s*=\s*)?\{?([A-Za-z0-9_]+)\.class"),
    Rule(JAVA, "EventType", r"(?:on|handle|consume|listen|process)\s*\(\s*([A-Za-z0-9_]+(?:Event|Command|Notification|Message))"),
    Rule(JAVA, "Annotation", r"@([A-Z][A-Za-z0-9_]+)", skip=("Override", "Deprecated", "SuppressWarnings", "Nullable", "NonNull", "Test")),
    Rule(JAVA, "Annotation", r"@[A-Z][A-Za-z0-9_]+\s*\(\s*(?:value\s*=\s*)?\{?([A-Za-z0-9_]+)\.class"),
    # Rust
    Rule(RUST, "Import", r"(?m)^\s*(?:pub\s+)?mod\s+([A-Za-z0-9_]+)\s*;", how="mod"),
    Rule(RUST, "Import", r"(?m)^\s*(?:pub\s+)?use\s+([A-Za-z0-9_:]+)(?:::\{[^}]*\})?\s*;", how="left"),
    Rule(RUST, "Implementation", r"impl(?:<[^>]+>)?\s+([A-Za-z0-9_]+\s+for\s+[A-Za-z0-9_]+)", each=NAME, skip=("for",)),
    Rule(RUST, "Attribute", r"#\[derive\(([^)]+)\)\]", each=NAME, skip=("Debug", "Clone", "Copy", "Default", "PartialEq", "Eq", "PartialOrd", "Ord", "Hash", "Serialize", "Deserialize")),
    # Kotlin
    Rule(KOTLIN, "Import", r"(?m)^\s*import\s+([A-Za-z0-9_.]+)"),
    Rule(KOTLIN, "ExtensionMethod", r"fun\s+(?:<[^>]+>\s+)?([A-Za-z0-9_]+)\.[A-Za-z0-9_]+\s*\("),
    Rule(KOTLIN, "Implementation", r"class\s+[A-Za-z0-9_]+(?:<[^>]+>)?\s*:\s*([^{]+)\{", each=r"([A-Za-z0-9_]+)"),
    Rule(KOTLIN, "BaseType", r"(?m)class\s+\w+[^:\n{]*:\s*([A-Za-z_][A-Za-z0-9_]*)[^{\n]*$"),  # an addition: classes without a body
    # PHP
    Rule(PHP, "Import", r"(?m)^\s*use\s+([A-Za-z0-9_\\]+)(?:\s+as\s+[A-Za-z0-9_]+)?\s*;"),
    Rule(PHP, "BaseType", r"class\s+[A-Za-z0-9_]+\s+extends\s+([A-Za-z0-9_]+)"),
    Rule(PHP, "Implementation", r"class\s+[A-Za-z0-9_]+(?:\s+extends\s+[A-Za-z0-9_]+)?\s+implements\s+([A-Za-z0-9_,\s]+)", each=NAME),
    Rule(PHP, "Attribute", r"#\[([A-Za-z0-9_]+)"),
    Rule(PHP, "Attribute", r"#\[[A-Za-z0-9_]+\(([^\]]+)\)\]", each=r"([A-Za-z0-9_]+)::class"),
    # Dart
    Rule(DART, "Import", r"(?m)^\s*import\s+['\"](?:package:)?([^'\"]+)['\"]", how="path"),
    Rule(DART, "CodeBehind", r"(?m)^\s*part\s+(?:of\s+)?['\"]([^'\"]+)['\"]\s*;", how="path"),
    Rule(DART, "BaseType", r"class\s+[A-Za-z0-9_]+\s+extends\s+([A-Za-z0-9_]+)"),
    Rule(DART, "EventType", r"\bon<([A-Za-z0-9_]+)>"),
    # C and C++
    Rule(CPP, "Import", r"(?m)^\s*#include\s+\"([^\"]+)\"", how="path", targets=CPP),
    Rule(CPP, "BaseType", r"(?:class|struct)\s+[A-Za-z0-9_]+\s*:\s*(?:public|protected|private)?\s*([A-Za-z0-9_]+)", targets=CPP),
    # C# and Razor
    Rule(CSHARP, "Attribute", r"(?m)^\s*\[([A-Z][A-Za-z0-9_]*)"),
    Rule(CSHARP, "Attribute", r"(?m)^\s*\[[A-Z][A-Za-z0-9_]*\(([^\]]*)\)\]", each=r"typeof\(([A-Za-z_][A-Za-z0-9_]*)\)"),
    Rule(CSHARP, "ObjectCreation", r"new\s+([A-Z][A-Za-z0-9_]*)\s*[(<{]"),
    Rule(CSHARP, "GenericArgument", r"<([A-Z][A-Za-z0-9_]*(?:\s*,\s*[A-Z][A-Za-z0-9_]*)*)>", each=NAME),
    Rule(RAZOR, "Service", r"(?m)^@inject\s+([A-Za-z_][A-Za-z0-9_]*)", targets=CSHARP),
    Rule(RAZOR, "ComponentUsage", r"<([A-Z][A-Za-z0-9_]*)[\s/>]", targets=(".razor",)),
]

#: Files that belong to one with the same stem: owner's extension, what follows the stem, kind.
COMPANIONS = [
    (".razor", ".razor.cs", "CodeBehind"), (".razor", ".razor.css", "Style"), (".razor", ".razor.js", "ScriptReference"),
    (".cpp", ".h", "CodeBehind"), (".h", ".cpp", "CodeBehind"), (".cc", ".h", "CodeBehind"), (".c", ".h", "CodeBehind"),
    *[(own, more, "StyleReference") for own in (".jsx", ".tsx", ".vue") for more in (".module.css", ".module.scss", ".css", ".scss")],
]
JS_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".json", ".css", ".scss", ".html", ".sass"]
SIBLING_EXTS = [".jsx", ".tsx", ".js", ".ts", ".vue"]
HELPERS = ["extensions.py", "ext.py", "helpers.py", "utils.py", "mixins.py"]


@dataclass(frozen=True)
class Declared:
    """A pattern of declarations: the group of the word that tells the kind (0: a function), and that of the name."""

    exts: tuple[str, ...]
    pattern: str
    word: int
    name: int


DECLARED = [
    Declared(JS, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|enum|type)\s+([A-Za-z0-9_]+)", 1, 2),
    Declared(JS, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z0-9_]+)\s*\(", 0, 1),
    Declared(JS, r"(?m)^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z0-9_]+)(?:\s*:\s*[A-Za-z0-9_<>.,\s\[\]]+)?\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z0-9_]+)\s*=>", 0, 1),
    Declared(PY, r"(?m)^\s*(class)\s+([A-Za-z0-9_]+)(?:\([^)]*\))?\s*:", 1, 2),
    Declared(PY, r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z0-9_]+)\s*\(", 0, 1),
    Declared(JAVA, r"(?<![A-Za-z0-9_])(class|interface|record|enum)\s+([A-Za-z0-9_]+)", 1, 2),
    Declared((".go",), r"type\s+([A-Za-z0-9_]+)\s+(struct|interface)", 2, 1),
    Declared((".go",), r"(?m)^func\s+(?:\([^)]+\)\s+)?([A-Za-z0-9_]+)\s*\(", 0, 1),
    Declared(RUST, r"(?m)^\s*(?:pub(?:\([^)]+\))?\s+)?(struct|enum|trait)\s+([A-Za-z0-9_]+)", 1, 2),
    Declared(RUST, r"(?m)^\s*(?:pub(?:\([^)]+\))?\s+)?fn\s+([A-Za-z0-9_]+)\s*\(", 0, 1),
    Declared(KOTLIN, r"(?m)^\s*(?:(?:open|abstract|sealed|data|enum|internal|public|private)\s+)*(class|interface)\s+([A-Za-z0-9_]+)", 1, 2),
    Declared(KOTLIN, r"(?m)^\s*fun\s+([A-Za-z0-9_]+)\s*\(", 0, 1),
    Declared(PHP, r"(?m)^\s*(?:abstract\s+|final\s+|readonly\s+)*(class|interface|enum|trait)\s+([A-Za-z0-9_]+)", 1, 2),
    Declared(PHP, r"(?m)^\s*function\s+([A-Za-z0-9_]+)\s*\(", 0, 1),
    Declared(DART, r"(?m)^\s*(?:abstract\s+)?(class|enum|mixin)\s+([A-Za-z0-9_]+)", 1, 2),
    Declared(CPP, r"(?m)^\s*(class|struct|enum)(?:\s+class)?\s+([A-Za-z0-9_]+)", 1, 2),
]
#: The kind that a word declares; any other word declares a class.
KINDS = ["class", "Class", "interface", "Interface", "trait", "Interface", "enum", "Enum", "type", "Type", "struct", "Struct", "record", "Record", "function", "Function"]
