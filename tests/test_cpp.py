"""The declaration parser: snippets with the records they must give."""

import pytest
from hypothesis import given, settings, strategies as st

from cairn.functions import cpp


def one(text, kind):
    rows = cpp.parse(text)[kind]
    assert len(rows) == 1, rows
    return rows[0]


def test_block_comment_across_lines():
    assert one("/* a\n b */\nclass AMyActor : public AActor {\n};", "classes")["name"] == "AMyActor"


def test_comment_within_declaration():
    c = one("class /* comment */ AMyActor : public AActor {};", "classes")
    assert (c["name"], c["parent_class"]) == ("AMyActor", "AActor")


def test_comment_in_body_hides_members():
    c = one("class AMyActor {\n /* int32 Hidden; */ int32 Value;\n};", "classes")
    assert [p["name"] for p in c["properties"]] == ["Value"]


@pytest.mark.parametrize("doc", ["/** This is the base actor class */", "/**\n * This is the\n * base actor class\n */", "/// This is the base\n/// actor class"])
def test_doc_comments(doc):
    assert one(f"{doc}\nUCLASS()\nclass AActor : public UObject {{}};", "classes")["doc"] == "This is the base actor class"


def test_doc_of_enum():
    e = one("/// Movement mode\n/// of a pawn\nUENUM()\nenum class EMovementMode : uint8 { Walking };", "enums")
    assert e["doc"] == "Movement mode of a pawn" and e["is_uenum"]


def test_enums():
    e = one("UENUM(BlueprintType)\nenum class EMode : uint8\n{\n Walking, Falling,\n Swimming\n};", "enums")
    assert (e["values"], e["is_uenum"], e["flags"], e["underlying"]) == (["Walking", "Falling", "Swimming"], True, ["BlueprintType"], "uint8")
    e = one("enum ECollisionChannel { ECC_WorldStatic, ECC_WorldDynamic, ECC_Pawn };", "enums")
    assert (e["values"], e["is_uenum"]) == (["ECC_WorldStatic", "ECC_WorldDynamic", "ECC_Pawn"], False)
    assert one('enum ERole { ROLE_None = 0, ROLE_A UMETA(DisplayName="x, y"), ROLE_MAX = 4 };', "enums")["values"] == ["ROLE_None", "ROLE_A", "ROLE_MAX"]
    assert len(cpp.parse("UENUM() enum class EA : uint8 { A };\nenum EB { B };")["enums"]) == 2


def test_enum_class_is_no_class_and_forward_declarations_are_none():
    assert cpp.parse("enum class E : uint8 { A };\nclass FForward;\nstruct FOther;")["classes"] == []


def test_specifiers():
    assert cpp.parse_specifiers("Blueprintable, Abstract", "class")["flags"] == ["Abstract", "Blueprintable"]
    assert cpp.parse_specifiers("NotBlueprintable", "class")["flags"] == ["NotBlueprintable"]
    p = cpp.parse_specifiers('EditAnywhere, BlueprintReadWrite, Category="MyCategory", meta=(ClampMin="0", ToolTip="a, b")', "property")
    assert (set(p["flags"]), p["category"], p["meta"]) == ({"EditAnywhere", "BlueprintReadWrite"}, "MyCategory", {"ClampMin": "0", "ToolTip": "a, b"})
    assert cpp.parse_specifiers("ReplicatedUsing=OnRep_X, Category=Game", "property")["flags"] == []
    assert cpp.parse_specifiers("Category=Game", "property")["category"] == "Game"


def test_properties_keep_their_macro():
    c = one('class A {\n UPROPERTY(EditAnywhere, Category="Game")\n float Health;\n UPROPERTY(BlueprintReadOnly)\n int32 Score = 3;\n TMap<FString, int32> M;\n};', "classes")
    assert [(p["name"], p["type"], p["is_uproperty"], p["category"]) for p in c["properties"]] == [("Health", "float", True, "Game"), ("Score", "int32", True, None), ("M", "TMap<FString, int32>", False, None)]


@pytest.mark.parametrize("text, name, kind, ret, n", [
    ("DECLARE_DELEGATE(FSimple);", "FSimple", "single", None, 0),
    ("DECLARE_MULTICAST_DELEGATE(FOnStart);", "FOnStart", "multicast", None, 0),
    ("DECLARE_DYNAMIC_MULTICAST_DELEGATE_TwoParams(FOnDamage, AActor*, DamagedActor, float, Damage);", "FOnDamage", "dynamic_multicast", None, 4),
    ("DECLARE_DELEGATE_RetVal(bool, FAsk);", "FAsk", "single", "bool", 0),
    ("DECLARE_DELEGATE_RetVal_OneParam(bool, FAsk,\n  TMap<int32, float>);", "FAsk", "single", "bool", 1),
])
def test_delegates(text, name, kind, ret, n):
    d = one(text, "delegates")
    assert (d["name"], d["kind"], d["return_type"], len(d["params"])) == (name, kind, ret, n)


def test_aliases():
    assert one("typedef TArray<FString> FStringArray;", "aliases")["underlying"] == "TArray<FString>"
    assert one("using FActorPtr = TSharedPtr<AActor>;", "aliases")["underlying"] == "TSharedPtr<AActor>"
    assert cpp.parse("using namespace UE::Core;")["aliases"] == []


def test_pure_virtual_and_deleted():
    r = cpp.parse("class IThing {\n virtual void DoSomething() = 0;\n IThing(const IThing&) = delete;\n};")
    assert r["classes"][0]["methods"] == ["void DoSomething() = 0"] and r["classes"][0]["is_interface"]
    assert one("virtual void BeginPlay() = 0;", "functions")["is_pure_virtual"]


@pytest.mark.parametrize("text, n", [("int a, float b, bool c", 3), ("TMap<FString, int32> MyMap, float Value", 2), ("TMap<FString, TArray<TPair<int, int>>> M, F(a, b) c", 2), ("", 0)])
def test_split_params(text, n):
    assert len(cpp.split_params(text)) == n


def test_parameters():
    assert cpp.parse_parameters("void") == []
    assert cpp.parse_parameters("const FString& Name = TEXT(\"x\"), int32")[0] == {"type": "const FString&", "name": "Name", "default": 'TEXT("x")'}
    assert cpp.parse_parameters("int32")[0]["type"] == "unknown"


def test_functions():
    text = "UFUNCTION(BlueprintCallable, Category=\"X\") static int32 Fn(TMap<FString, int32> M, float Q = 2) const;"
    f = one(text, "functions")
    assert (f["name"], f["return_type"], f["is_static"], f["is_const"], f["is_blueprint_callable"], f["category"], len(f["parameters"])) == ("Fn", "int32", True, True, True, "X", 2)
    assert f["signature"] == "int32 Fn(TMap<FString, int32> M, float Q = 2) const"


def test_namespaces_and_lines():
    c = one("namespace UE::Core {\nnamespace Inner {\n\nstruct FData { int32 X; };\n}\n}\n", "classes")
    assert (c["namespace"], c["line"], c["is_struct"]) == ("UE::Core::Inner", 4, True)


def test_body_ends_at_its_brace():
    r = cpp.parse("class A\n{\n int32 X;\n};\nint32 Global(int32 a);\nclass B { int32 Y; };")
    assert [[p["name"] for p in c["properties"]] for c in r["classes"]] == [["X"], ["Y"]]
    assert [f["class_name"] for f in r["functions"]] == [None]


def test_calls():
    text = 'void Fn(int a) { if (a) { Go(1, "No(x)"); } /* Not(1) */ Other(2); }\nint AX::Get() const { return Go(3); }'
    assert cpp.calls(text) == [("Fn", "Go"), ("Fn", "Other"), ("Get", "Go")]
    twice = "void F() { A1(); }\nvoid F(int x) { B1(); }"
    assert cpp.calls(twice, by_name=True) == [("F", "B1")]


def test_null_and_empty():
    assert all(v == [] for v in cpp.parse(None).values()) and all(v == [] for v in cpp.parse("").values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='abAB(){};:,<>="/*#\n \\\'', max_size=200))
def test_never_fails_and_keeps_lines(text):
    cpp.parse(text)
    assert cpp.strip_comments(text).count("\n") == text.count("\n") and len(cpp.strip_comments(text)) == len(text)


def test_all_kinds_are_counted_in_one_parse(spark):
    """Four kinds of a text cost one pass through Python; texts without records, and kinds without any, count 0."""
    from cairn.functions import parsing

    df = spark.createDataFrame([(1, '#include "a.h"\nclass A { int32 B(); };\nenum E { X };'), (2, None), (3, "void F(int a);\nvoid G(int a);")], "id long, text string")
    out = parsing.count_kinds(df, ("classes", "functions", "enums", "includes", "delegates"))
    assert {r.kind: r.n for r in out.collect()} == {"classes": 1, "functions": 3, "enums": 1, "includes": 1, "delegates": 0}
    from cairn.plans.registry import QUERIES

    plan = QUERIES["PAR01_all_kinds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
