"""C# sources: what each declared type's members and expressions refer to, and the files that they resolve to.

Strings, comments and preprocessor lines are blanked first, so that nothing is read out of them.  The
rest is cut at braces and semicolons, and one scan over the pieces counts brace depth and keeps a
stack of open types, which gives every piece its declaring type.  Patterns then turn pieces into
facts: references, declarations, implemented bases, handled events, extension methods.  All of this is
column expressions in one pass; only names move into the joins that resolve them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import tables
from sparkloom.functions.text import any_of, extension, stem
from sparkloom.sources.shared import materialise

from .languages import CSHARP, RAZOR

#: An identifier, a name with dots, and a type with its arguments (three levels), nullable and array marks.
ID = r"[A-Za-z_][A-Za-z0-9_]*+"
DOTTED = rf"{ID}(?:\.{ID})*+"
_ANGLE = r"<(?:[^<>(){}]|<(?:[^<>(){}]|<[^<>(){}]*+>)*+>)*+>"
TYPE = rf"{DOTTED}(?:{_ANGLE})?(?:\?|\[[\s,]*+\])*+"
_BEFORE = r"(?<![A-Za-z0-9_.])"
_WORD = r"(?<![A-Za-z0-9_])"

#: Raw, verbatim and plain strings, characters, comments, preprocessor lines.
MASKED = r"\"\"\"[\s\S]*?(?:\"\"\"|\z)|(?:@\$?|\$@)\"(?:[^\"]|\"\")*+(?:\"|\z)|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+|(?m:^[ \t]*+#[^\n]*+)"
PIECE = r"[^{};]*+[{};]|[^{};]++\z"
DECLARES = rf"(?:^|[\s\]])(?:class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?!where\s)({ID})"
_ATTRS = r"^\s*+(?:\[[^\]]*+\]\s*+)*+"
_MODS = r"(?:(?:public|private|protected|internal|static|readonly|const|virtual|override|abstract|sealed|async|extern|unsafe|new|partial|volatile|required|event|ref|implicit|explicit|file)\s++)*+"
_PARAMS = r"\(((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+)\)"
CONSTRUCTOR = rf"{_ATTRS}{_MODS}({ID})\s*+{_PARAMS}"
METHOD = rf"{_ATTRS}{_MODS}({TYPE})\s++(?:{ID}\.)*({ID})\s*+(?:<[^<>()]*+>)?\s*+{_PARAMS}"
PROPERTY = rf"{_ATTRS}{_MODS}({TYPE})\s++(?:{ID}\.)*{ID}\s*+(?:=>|\z)"
FIELD = rf"{_ATTRS}{_MODS}({TYPE})\s++{ID}\s*+(?:=(?![=>])|,|\z)"
PARAMETER = rf"(?:^|,)\s*+(?:\[[^\]]*+\]\s*+)*+(?:(?:this|ref|out|in|params|scoped|readonly)\s++)*+({TYPE})\s++@?{ID}(?:\s*+=[^,]*+)?"
LOCAL = rf"^\s*+(?:(?:const|using|await|ref|readonly)\s++)*+(?!(?:return|throw|else|goto|yield|await|new|case|using|namespace|in|out|is|as|var)\s)({TYPE})\s++{ID}\s*+(?:=(?![=>])|,|\z)"
#: What a member or local variable is declared as, before its own name.
NAMED = rf"^(\s*+{_MODS}(?!(?:return|throw|else|goto|yield|await|new|case|using|namespace|in|out|is|as)\s){TYPE})\s++(?:{ID}\.)*{ID}(?=\s*+(?:[=,(<]|\z))"
LOOPED = rf"{_WORD}(?:foreach|for|using|fixed)\s*+\(\s*+(?:await\s++|const\s++)*+({TYPE})\s++{ID}\s*+(?:in\s|=)"
CALLED = rf"{_BEFORE}((?:{ID}\.)+){ID}\s*+(?:<[^<>()]*+>)?\("
READ = rf"{_BEFORE}((?:{ID}\.)+){ID}(?![A-Za-z0-9_])(?!\s*+\()"
MAYBE = rf"{_BEFORE}((?:{ID}\.)*{ID})\?\."
CREATED = rf"{_WORD}new\s++({DOTTED})(?:{_ANGLE})?\s*+(?:\(|\z)"
ARGUMENTS = rf"(?<=[A-Za-z0-9_])<((?:[^<>(){{}}]|<(?:[^<>(){{}}]|<[^<>(){{}}]*+>)*+>)*+)>"
CAST = rf"(?<![A-Za-z0-9_>\])])(?<!{_WORD}(?:if|while|switch|lock|using|catch|foreach|for|when|typeof|nameof|sizeof|default)\s{{1,3}})\(\s*+({TYPE})\s*+\)\s*+(?=[A-Za-z_(@~!])"
TESTED = rf"{_WORD}(?:is|as)\s++(?:not\s++)?({TYPE})"
TYPEOF = rf"{_WORD}(?:typeof|default)\s*+\(\s*+({TYPE})\s*+\)"
CAUGHT = rf"{_WORD}catch\s*+\(\s*+({TYPE})(?:\s++{ID})?\s*+\)"
CONSTRAINT = rf"{_WORD}where\s++{ID}\s*+:\s*+([^;]*?)(?=\swhere\s|=>|\z)"
INVOKED = rf"\.\s*+({ID})\s*+(?:<[^<>()]*+>)?\s*+\("
USING = rf"^\s*+(?:global\s++)?using\s++(?:static\s++|{ID}\s*+=\s*+)({DOTTED})"
BASES = rf"{DECLARES}(?:\s*+<[^<>]*+(?:<[^<>]*+>[^<>]*+)*+>)?(?:\s*+{_PARAMS})?\s*+:\s*+((?:(?!\swhere\s)[\s\S])*+)"
#: Interfaces and methods that handle an event.
HANDLES = _WORD + r"(?:IRequestHandler|INotificationHandler|IConsumer|IEventHandler|IHandleMessages|IHandle)\s*<\s*([A-Za-z0-9_]+)"
RECEIVES = _WORD + r"(?:Handle|Consume|Receive|OnEvent|Subscribe)\s*\(\s*(?:ConsumeContext<\s*)?([A-Za-z0-9_]+(?:Event|Command|Notification|Message))(?![A-Za-z0-9_])"


def mask(text: Column) -> Column:
    """The text with each string, comment and preprocessor line as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), MASKED, " ")


_PIECES = "array<struct<owner:string,place:string,ends:string,code:string>>"


def pieces(text: Column) -> Column:
    """Pieces of code in order: declaring type (null outside any), place, sign at the end, code.

    Places: "type" (a declaration; its own owner), "member" (directly in a type), "code" (deeper, or outside).  A
    nested type's pieces are its own.  Braces that do not match are taken as they come; depth is never below 0.
    """
    cut = F.regexp_extract_all(mask(text), F.lit(PIECE), F.lit(0))

    def read(s: Column) -> Column:
        ends = F.regexp_extract(s, r"[{};]\z", 0)
        code = F.regexp_replace(F.regexp_replace(s, r"[{};]\z", ""), r"^\s++|\s++\z", "")
        return F.struct(code.alias("code"), ends.alias("ends"), F.regexp_extract(code, DECLARES, 1).alias("name"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<name:string,level:int>>").alias("open"), F.array().cast(_PIECES).alias("out"))

    def step(a: Column, x: Column) -> Column:
        top = F.try_element_at(a["open"], F.lit(-1))
        is_type = x["name"] != ""
        deeper, shallower = x["ends"] == "{", x["ends"] == "}"
        depth = F.when(deeper, a["depth"] + 1).when(shallower, F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        place = F.when(is_type, "type").when(a["depth"] == top["level"] + 1, "member").otherwise("code")
        piece = F.struct(F.when(is_type, x["name"]).otherwise(top["name"]).alias("owner"), place.alias("place"), x["ends"].alias("ends"), x["code"].alias("code"))
        opened = F.when(deeper & is_type, F.concat(a["open"], F.array(F.struct(x["name"].alias("name"), a["depth"].alias("level")))))
        opened = opened.when(shallower & (top["level"] >= depth), F.slice(a["open"], 1, F.size(a["open"]) - 1)).otherwise(a["open"])
        return F.struct(depth.alias("depth"), opened.alias("open"), F.when(x["code"] != "", F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.transform(cut, read), start, step, lambda a: a["out"])


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _each(found: Column, pattern: str = rf"({ID})") -> Column:
    return F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))


def _simple(found: Column) -> Column:
    """The last name of each type, without arguments and marks."""
    return F.transform(found, lambda t: F.regexp_extract(F.regexp_replace(t, r"[<\[?][\s\S]*", ""), rf"({ID})\s*\z", 1))


_FACT = "array<struct<fact:string,rel:string,name:string>>"


def _facts(fact: str, rel: str | None, names: Column, when: Column | None = None) -> Column:
    made = F.transform(names, lambda n: F.struct(F.lit(fact).alias("fact"), F.lit(rel).cast("string").alias("rel"), n.alias("name")))
    return made if when is None else F.when(when, made).otherwise(F.array().cast(_FACT))


_NONE = "array<string>"


def _if(text: Column, signs: tuple[str, ...], found: Column) -> Column:
    """What a pattern finds, where the text holds one of the signs without which it finds nothing: most pieces are passed over so."""
    return F.when(any_of([text.contains(x) for x in signs]), found).otherwise(F.array().cast(_NONE))


def _read(row: Column) -> Column:
    """A piece with what the patterns of members take from it, each tried once and on pieces in its place only."""
    code, member = row["code"], row["place"] == "member"
    at = lambda pattern, group, cond: F.when(cond, F.regexp_extract(code, pattern, group)).otherwise("")
    call = member & code.contains("(")
    fields = [row[c].alias(c) for c in ("owner", "place", "ends", "code", "bare", "attrs")]
    using = code.contains("using") & code.rlike(USING)
    return F.struct(*fields, at(CONSTRUCTOR, 1, call).alias("c1"), at(METHOD, 0, call).alias("m0"), using.alias("using"))


def _acting(row: Column) -> Column:
    """The piece with its parameters, where it is a constructor, a method or a type that has them.

    A field of a lambda's variable is worked out anew at each mention, so each step keeps in the row what later ones mention.
    """
    code, m0, member, is_type = row["code"], row["m0"], row["place"] == "member", row["place"] == "type"
    makes = member & (row["c1"] != "") & (row["c1"] == row["owner"])
    acts = member & ~makes & (m0 != "") & ~m0.contains("=")
    own = F.when(makes, F.regexp_extract(code, CONSTRUCTOR, 2)).when(acts, F.regexp_extract(m0, METHOD, 3)).when(is_type & code.contains("("), F.regexp_extract(code, DECLARES + rf"(?:\s*+{_ANGLE})?\s*+{_PARAMS}", 2)).otherwise("")
    fields = [row[c].alias(c) for c in ("owner", "place", "ends", "code", "bare", "attrs", "m0", "using")]
    return F.struct(*fields, makes.alias("makes"), acts.alias("acts"), own.alias("own"))


def _typed(row: Column) -> Column:
    """The piece with the types of its parameters, of its bases and of itself, where it is a property or a field."""
    code, ends, own, is_type = row["code"], row["ends"], row["own"], row["place"] == "type"
    rest = (row["place"] == "member") & ~row["makes"] & ~row["acts"]
    has = F.when(rest & ((ends == "{") | code.contains("=>")), F.regexp_extract(code, PROPERTY, 1)).otherwise("")
    holds = F.when(rest, F.regexp_extract(code, FIELD, 1)).otherwise("")
    bases = F.when(is_type & code.contains(":"), _simple(_all(F.regexp_extract(code, BASES, 3), rf"(?:^|,)\s*+({TYPE})"))).otherwise(F.array().cast(_NONE))
    fields = [row[c].alias(c) for c in ("owner", "place", "ends", "code", "bare", "attrs", "m0", "using", "makes", "acts", "own")]
    return F.struct(*fields, has.alias("has"), holds.alias("holds"), _if(own, (" ",), _simple(_all(own, PARAMETER))).alias("params"), bases.alias("bases"))


def _found(row: Column) -> Column:
    """The facts of one piece."""
    owner, place, code, bare, attrs, m0, using, makes, acts, own_params, params, bases = (row[c] for c in ("owner", "place", "code", "bare", "attrs", "m0", "using", "makes", "acts", "own", "params", "bases"))
    member, is_type = place == "member", place == "type"
    has = row["has"] != ""
    holds = ~has & (row["holds"] != "")
    method = F.when(acts, F.regexp_extract(m0, METHOD, 1))
    contracts, classes = F.filter(bases, lambda b: b.rlike(r"^I\p{Lu}")), F.filter(bases, lambda b: ~b.rlike(r"^I\p{Lu}"))
    plain = F.when(is_type, F.regexp_replace(bare, DECLARES, " ")).otherwise(F.regexp_replace(bare, NAMED, "$1"))
    held = F.when(holds, F.array(row["holds"])).when(place == "code", _all(bare, LOCAL)).otherwise(F.array().cast(_NONE))
    tried = lambda pattern, *signs: _if(bare, signs, _all(bare, pattern))
    any_code = ~using
    return F.concat(
        _facts("import", "Import", _simple(_all(code, USING)), using),
        _facts("declares", None, F.array(owner), is_type),
        _facts("partial", "PartialDeclaration", F.array(owner), is_type & bare.rlike(_WORD + r"partial\s")),
        _facts("ref", "BaseType", classes),
        _facts("ref", "Interface", contracts),
        _facts("implements", None, bases, is_type & code.rlike(_WORD + r"(?:class|record|struct)\s")),
        _facts("ref", "ConstructorDependency", params, is_type | makes),
        _facts("ref", "ReturnType", _simple(F.array(method)), acts & ~method.isin("void", "Task")),
        _facts("ref", "ParameterType", params, acts),
        _facts("extends", None, F.array(F.regexp_extract(m0, METHOD, 2)), acts & own_params.rlike(r"^\s*+(?:\[[^\]]*+\]\s*+)*+this\s") & m0.rlike(_WORD + r"static\s")),
        _facts("ref", "PropertyType", _simple(F.array(row["has"])), has),
        _facts("ref", "FieldType", _simple(F.array(row["holds"])), holds),
        _facts("ref", "LocalType", _simple(F.concat(held, tried(LOOPED, "for", "using", "fixed"), tried(TESTED, "is", "as"), tried(TYPEOF, "typeof", "default"))), any_code),
        _facts("attribute", "Attribute", F.flatten(F.transform(_each(F.array(attrs)), lambda a: F.array(a, F.concat(a, F.lit("Attribute"))))), (is_type | member) & (attrs != "")),
        _facts("ref", "MethodCall", _each(_if(bare, (".",), tried(CALLED, "("))), any_code),
        _facts("ref", "FieldType", F.concat(_each(tried(READ, ".")), _each(tried(MAYBE, "?."))), any_code),
        _facts("ref", "ObjectCreation", _simple(tried(CREATED, "new")), any_code),
        _facts("ref", "GenericArgument", _each(tried(ARGUMENTS, "<")), any_code),
        _facts("ref", "ConversionType", _simple(tried(CAST, ")")), any_code),
        _facts("ref", "ExceptionType", _simple(tried(CAUGHT, "catch")), any_code),
        _facts("ref", "GenericConstraint", _each(tried(CONSTRAINT, "where")), any_code),
        _facts("net", "FieldType", F.filter(_all(plain, rf"{_BEFORE}({ID})(?!\s*+<)"), lambda n: owner.isNull() | (n != owner)), any_code),
        _facts("call", "ExtensionMethod", _if(bare, (".",), tried(INVOKED, "(")), any_code),
        _facts("handles", None, F.concat(_if(code, ("Handle", "Consumer"), _all(code, HANDLES)), _if(code, ("Event", "Command", "Notification", "Message"), _all(code, RECEIVES))), any_code),
    )


def facts(files: DataFrame) -> DataFrame:
    """(path, owner, fact, rel, name) of C# files (path, content), each once.

    Facts: "ref" (a reference of kind rel), "attribute", "import", "partial" and "net" (any other
    identifier), "call" (an invoked method's name); "declares" a type, "implements" a base, "handles" an
    event, "extends" by a method of that name.  A null text has none.
    """
    rows = files.where(extension(F.col("path")).isin(*CSHARP)).select("path", pieces(F.col("content")).alias("p"))
    typed = F.exists("p", lambda x: x["place"] == "type")
    # Outside any type only usings count, but in a file of plain statements.
    kept = F.filter("p", lambda x: x["owner"].isNotNull() | ~typed | x["code"].rlike(USING))
    rows = rows.select("path", F.explode(kept).alias("x")).select("path", "x.*")
    rows = rows.withColumn("bare", F.regexp_replace("code", _ATTRS, "")).withColumn("attrs", F.regexp_extract("code", _ATTRS, 0))
    # As a lambda over one row's fields: generated code for all patterns at once would be over the JVM's limit of a method.
    row = F.array(F.struct("owner", "place", "ends", "code", "bare", "attrs"))
    for step in (_read, _acting, _typed):
        row = F.transform(row, step)
    found = F.flatten(F.transform(row, _found))
    out = rows.select("path", "owner", F.explode(F.array_distinct(found)).alias("f")).select("path", "owner", "f.*")
    return out.where((F.col("name") != "") & ~F.col("name").isin(tables.SYSTEM_TYPES)).distinct()


def type_index(found: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(name, dst): files that declare a type, and pages (path) that are components by their own name."""
    out = found.where("fact = 'declares'").select("name", F.col("path").alias("dst"))
    if pages is not None:
        own = pages.where(extension(F.col("path")).isin(*RAZOR)).select(stem(F.col("path")).alias("name"), F.col("path").alias("dst"))
        out = out.unionByName(own)
    return out.distinct()


def resolve(found: DataFrame, pages: DataFrame | None = None, *, sources: DataFrame | None = None, attributes: bool = True, implementations: bool = True, event_subscribers: bool = True, safety_net: bool = True) -> DataFrame:
    """(src, owner, dst, rel, confidence) of written ``facts``, in stages.

    A referred name leads to the files that declare it; then, each under its switch, to those that
    implement it ("Implementation") and those that handle it ("EventType").  Attributes are looked up as
    ``X`` and as ``XAttribute``.  Imports, partial declarations and the net of other identifiers lead to
    declaring files only; invoked methods lead to files with an extension method of the name.  A file is never its own target.

    A base that a files name and b implement gives a * b rows; ``sources`` (path) asks for the edges of some files only.
    """
    types = materialise(type_index(found, pages))
    asking = found if sources is None else found.join(sources.select("path").distinct(), "path", "left_semi")
    wanted = ["ref", "import", "partial", *(["attribute"] if attributes else []), *(["net"] if safety_net else [])]
    refs = asking.where(F.col("fact").isin(*wanted)).select("path", "owner", "fact", "rel", "name")
    told = lambda df, rel, sure: df.where(F.upper("path") != F.upper("dst")).select(F.col("path").alias("src"), "owner", "dst", rel.alias("rel"), F.lit(sure).alias("confidence"))
    out = told(refs.join(types, "name"), F.col("rel"), "Verified")
    full = refs.where("fact IN ('ref', 'attribute')")
    index = lambda fact: found.where(F.col("fact") == fact).select("name", F.col("path").alias("dst")).distinct()
    if implementations:
        out = out.unionByName(told(full.join(index("implements"), "name"), F.lit("Implementation"), "High"))
    if event_subscribers:
        out = out.unionByName(told(full.join(index("handles"), "name"), F.lit("EventType"), "Verified"))
    calls = asking.where("fact = 'call'").select("path", "owner", "name")
    out = out.unionByName(told(calls.join(index("extends"), "name"), F.lit("ExtensionMethod"), "Verified"))
    return out.distinct()


def edges(files: DataFrame, **switches: bool) -> DataFrame:
    """(src, dst, rel) of C# files among (path, content); see ``resolve`` for the switches."""
    found = materialise(facts(files))
    return resolve(found, files.select("path"), **switches).select("src", "dst", "rel").distinct()
