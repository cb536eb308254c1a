"""Property sheets, their conditions and what projects take from them."""

import pytest

from graphloom.sources import build, sheets
from graphloom.sources.sheets import sheet_settings, statements

FILE = "path string, text string"


def definitions(**settings):
    return "<ItemDefinitionGroup><ClCompile>" + "".join(f"<{k}>{v}</{k}>" for k, v in settings.items()) + "</ClCompile></ItemDefinitionGroup>"


def imports(*paths):
    return "<ImportGroup>" + "".join(f'<Import Project="{p}"/>' for p in paths) + "</ImportGroup>"


def settle(spark, project, files=(), config="Release|Win32", path="/r/app/a.vcxproj", **more):
    rows = [(p, f"<Project>{t}</Project>" if t is not None else None) for p, t in dict(files).items()]
    listed = more.pop("listed", None)
    listed = None if listed is None else spark.createDataFrame([(p,) for p in listed], "path string")
    found = sheet_settings(spark.createDataFrame([(path, f"<Project>{project}</Project>")], FILE), spark.createDataFrame(rows, FILE), config, listed, **more)
    return found.first().asDict()


@pytest.mark.parametrize("condition, want", [
    ("", True), ("'$(Configuration)'=='release'", True), ("'$(Configuration)|$(Platform)' == 'Debug|x64'", False), ("'$(A)'!='1'", False),
    ("Exists('/there')", True), ("!Exists('/there')", False), ("! exists('/gone') and '$(A)'=='1'", True), ("!('a'=='a' Or 'b'=='c')", False),
    ("'a'=='b' or 'a'=='a' and 'x'=='y'", False), ("('a'=='b' or 'a'=='a') and !('x'=='y')", True), ("$(A)==1", True), ("'$(None)'==''", False), ("something else", True), ("false", False),
])
def test_conditions(condition, want):
    assert sheets.holds(condition, {"Configuration": "Release", "A": "1"}, lambda p: p == "/there") == want


def test_paths_and_values():
    assert sheets.placed("..\\..\\inc\\.", "/r/app/x") == "/r/inc" and sheets.placed("C:\\a\\..\\b", "/r") == "C:/b"
    assert sheets.expand("$(A)/$(B)/$(C)", {"A": "$(B)", "B": "1"}) == "1/1/$(C)" and "$(A)" in sheets.expand("$(A)", {"A": "x$(A)"})
    assert statements("no xml", False) == [] and statements(None, True) == []


def test_sheets_three_deep_in_order_and_a_cycle(spark):
    files = {
        "/r/props/one.props": imports("two.props") + "<PropertyGroup><Lib>one</Lib><Path>$(Path);one</Path></PropertyGroup>" + definitions(AdditionalIncludeDirectories="$(Lib);$(Path);%(AdditionalIncludeDirectories)", PreprocessorDefinitions="ONE"),
        "/r/props/two.props": "<PropertyGroup><Path>two</Path></PropertyGroup>" + imports("deep/three.props") + definitions(AdditionalIncludeDirectories="$(Lib)", PreprocessorDefinitions="TWO;;%(PreprocessorDefinitions)", AdditionalOptions="/two"),
        "/r/props/deep/three.props": imports("../one.props", "three.props") + "<PropertyGroup><Lib>three</Lib></PropertyGroup>" + definitions(AdditionalIncludeDirectories="$(MSBuildThisFileDirectory)x", AdditionalOptions="/three $(Platform)"),
        "/r/props/last.props": definitions(PreprocessorDefinitions="LAST=$(Lib)"),
    }
    got = settle(spark, imports("..\\Props\\One.props", "$(VCTargetsPath)\\x.props", "..\\props\\none.props", "..\\props\\last.props"), files)
    assert got["imported"] == ["/r/props/one.props", "/r/props/two.props", "/r/props/deep/three.props", "/r/props/last.props"]
    assert got["includes"] == ["/r/props/deep/x", "/r/props/three", "/r/props/one", "/r/props/two", "/r/props/one"]
    assert got["defines"] == ["TWO", "ONE", "LAST=one"] and got["options"] == "/three Win32 /two"
    assert got["variables"]["PlatformShortName"] == "x86" and got["variables"]["Path"] == "two;one" and got["variables"]["ProjectDir"] == "/r/app/"


def test_the_root_is_found_by_asking_for_files(spark):
    root = (
        "<PropertyGroup><RootProjectDir>$(MSBuildProjectDirectory)\\..\\</RootProjectDir></PropertyGroup>"
        + "<PropertyGroup Condition=\"!Exists('$(RootProjectDir)Main.sln')\"><RootProjectDir>$(RootProjectDir)\\..\\</RootProjectDir></PropertyGroup>" * 3
        + "<PropertyGroup><All>$(RootProjectDir)a;$(RootProjectDir)b</All></PropertyGroup>" + definitions(AdditionalIncludeDirectories="$(All)")
    )
    deep = settle(spark, imports("/p/root.props"), {"/p/root.props": root}, path="/R/one/two/app/a.vcxproj", listed=["/r/main.sln"])
    assert deep["includes"] == ["/R/a", "/R/b"] and deep["variables"]["RootProjectDir"] == "/R/"
    near = settle(spark, imports("/p/root.props"), {"/p/root.props": root}, path="/R/one/two/app/a.vcxproj", listed=["/R/one/two/main.sln"])
    assert near["includes"] == ["/R/one/two/a", "/R/one/two/b"]


def test_folders_exist_and_conditions_of_imports(spark):
    files = {"/r/lib/a.props": definitions(PreprocessorDefinitions="A"), "/r/lib/b.props": definitions(PreprocessorDefinitions="B"), "/r/lib/empty.props": None}
    project = (
        "<ImportGroup Condition=\"'$(Configuration)|$(Platform)'=='Debug|Win32'\"><Import Project='/r/lib/a.props'/></ImportGroup>"
        "<ImportGroup><Import Project='/r/lib/b.props' Condition=\"exists('$(SolutionDir)lib')\"/><Import Project='/r/lib/a.props' Condition=\"exists('/r/other')\"/><Import Project='/r/lib/empty.props'/></ImportGroup>"
    )
    got = settle(spark, project, files, solution_dir="\\r")
    assert got["defines"] == ["B"] and got["imported"] == ["/r/lib/b.props", "/r/lib/empty.props"]


def test_settings_of_sheets_with_conditions(spark):
    sheet = definitions(PreprocessorDefinitions="ALWAYS") + definitions(PreprocessorDefinitions="DEBUG").replace("<ItemDefinitionGroup>", "<ItemDefinitionGroup Condition=\"'$(Configuration)'=='Debug'\">")
    assert settle(spark, imports("/s.props"), {"/s.props": sheet})["defines"] == ["ALWAYS", "DEBUG"]
    assert settle(spark, imports("/s.props"), {"/s.props": sheet}, strict=True)["defines"] == ["ALWAYS"]


def test_projects_take_what_their_sheets_set(spark):
    own = imports("root.props") + definitions(
        AdditionalIncludeDirectories="..\\inc;$(RootProjectDir)gen", PreprocessorDefinitions="OWN;$(Kind)", AdditionalOptions="/own $(Kind)", PrecompiledHeader="Use", PrecompiledHeaderFile="pch.h",
        RuntimeLibrary="MultiThreaded", RuntimeTypeInfo="true",
    ) + "<PropertyGroup><PlatformToolset>v142</PlatformToolset></PropertyGroup><ItemGroup><ClCompile Include='a.cpp'/><ClCompile Include='b.h'/><ClCompile Include='pch.CPP'><PrecompiledHeader>Create</PrecompiledHeader></ClCompile></ItemGroup>"
    sheet = "<PropertyGroup><RootProjectDir>..</RootProjectDir><Kind>k</Kind></PropertyGroup>" + definitions(AdditionalIncludeDirectories="sdk", PreprocessorDefinitions="SHEET", AdditionalOptions="/sheet")
    files = spark.createDataFrame([("/r/app/a.vcxproj", f"<Project>{own}</Project>"), ("/r/b/b.vcxproj", "<Project/>")], FILE)
    got = {r["path"]: r for r in build.projects(files, "Release|x64", spark.createDataFrame([("/r/app/root.props", f"<Project>{sheet}</Project>")], FILE)).collect()}
    a = got["/r/app/a.vcxproj"]
    assert a["includes"] == ["/r/app/sdk", "/r/inc", "/r/gen"] and a["defines"] == ["SHEET", "OWN", "k"] and a["options"] == "/sheet /own k"
    assert (a["pch"], a["pch_file"], a["runtime"], a["rtti"], a["toolset"]) == ("Use", "pch.h", "MultiThreaded", "true", "v142")
    assert [(s["_Include"], s["pch"]) for s in a["sources"]] == [("a.cpp", None), ("pch.CPP", "Create")] and got["/r/b/b.vcxproj"]["includes"] == []


def test_managed_files_of_a_managed_project(spark):
    items = "<ItemGroup><ClCompile Include='a.cpp'/><ClCompile Include='b.cpp'><CompileAsManaged Condition=\"x Release|x64\">false</CompileAsManaged></ClCompile></ItemGroup>"
    files = spark.createDataFrame([("/r/a.vcxproj", f"<Project>{definitions(AdditionalOptions='/clr:pure')}{items}</Project>")], FILE)
    parsed = build.projects(files, "Release|x64")
    assert [s["CompileAsManaged"] for s in parsed.first()["sources"]] == ["true", "false"]
    assert [r["file"] for r in build.compile_commands(parsed).collect()] == ["/r/b.cpp"]
