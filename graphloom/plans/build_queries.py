"""Queries over build metadata written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.catalog import query
from graphloom.plans.retail import Tables
from graphloom import steps
from graphloom.sources import build


@query(
    "msvc_flags",
    """SELECT p_partkey, '/W' || (p_size % 5) || ' ' || '/D' || replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN ' /Od' ELSE '' END AS flags FROM part""",
)
def msvc_flags(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit("  /MP /W"), (F.col("p_size") % 5).cast("string"), F.lit(" /Yupch.h %(AdditionalOptions)  /D"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
        F.lit(" /Fdx.pdb /fp:fast "), F.when(F.col("p_size") % 3 == 0, "/Od").otherwise("/Ox"),
    )
    return t.part.select("p_partkey", F.array_join(build.translate_flags(build.split_options(raw)), " ").alias("flags"))


def _guid(column: str):
    return F.concat(F.lit("abc-"), F.col(column).cast("string"))


@query(
    "solution_projects",
    """SELECT 'n' || s_nationkey || '_' || (s_suppkey // 100) || '.sln' AS path, s_name AS name, 'ABC-' || s_suppkey AS guid, 'p' || s_suppkey || '\\p.vcxproj' AS relative_path,
       CASE WHEN s_suppkey > 0 THEN 'ABC-' || (s_suppkey - 1) ELSE '' END AS dependencies FROM supplier""",
)
def solution_projects(t: Tables) -> DataFrame:
    """A solution per nation and hundred suppliers with a project each, needing the one before."""
    dep = F.when(F.col("s_suppkey") > 0, F.concat(
        F.lit("\tProjectSection(ProjectDependencies) = postProject\r\n\t\t{abc-"), (F.col("s_suppkey") - 1).cast("string"), F.lit("} = {abc-"),
        (F.col("s_suppkey") - 1).cast("string"), F.lit("}\r\n\tEndProjectSection\r\n"))).otherwise("")
    block = F.concat(
        F.lit('Project("{8bc9ceb8}") = "'), "s_name", F.lit('", "p'), F.col("s_suppkey").cast("string"), F.lit('\\p.vcxproj", "{'), _guid("s_suppkey"), F.lit('}"\r\n'), dep, F.lit("EndProject\r\n")
    )
    slns = t.supplier.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("_"), F.floor(F.col("s_suppkey") / 100).cast("string"), F.lit(".sln")).alias("path")).agg(F.array_join(F.collect_list(block), "").alias("text"))
    out = build.solution_projects(slns)
    return out.select("path", "name", "guid", "relative_path", F.array_join("dependencies", ",").alias("dependencies"))


@query(
    "compile_commands",
    """SELECT '/r/p' || p_partkey || '/src/a.cpp' AS file, 'clang-cl /std:c++17 /DK=' || p_partkey || ' /DNDEBUG /D_LIB /I/r/p' || p_partkey || '/inc /I/sdk/Release /W' || (1 + p_size % 4) ||
       ' /EHsc /bigobj -fms-compatibility -fms-extensions -fdelayed-template-parsing -Wno-everything -ferror-limit=50 /c /r/p' || p_partkey || '/src/a.cpp' AS arguments FROM part""",
)
def compile_commands(t: Tables) -> DataFrame:
    """A project file per part with one native and one managed source."""
    k = F.col("p_partkey").cast("string")
    xml = F.concat(
        F.lit('<Project><PropertyGroup Label="Globals"><ProjectGuid>{ab}</ProjectGuid><RootNamespace>P</RootNamespace></PropertyGroup>'
              "<PropertyGroup Condition=\"'$(Configuration)|$(Platform)'=='Release|x64'\" Label=\"Configuration\"><ConfigurationType>StaticLibrary</ConfigurationType></PropertyGroup>"
              "<PropertyGroup Condition=\"'$(Configuration)|$(Platform)'=='Debug|x64'\" Label=\"Configuration\"><ConfigurationType>DynamicLibrary</ConfigurationType></PropertyGroup>"
              "<ItemDefinitionGroup Condition=\"'$(Configuration)|$(Platform)'=='Release|x64'\"><ClCompile><AdditionalIncludeDirectories>inc;/sdk/$(Configuration);%(AdditionalIncludeDirectories)</AdditionalIncludeDirectories><PreprocessorDefinitions>K="),
        k, F.lit(";NDEBUG;%(PreprocessorDefinitions)</PreprocessorDefinitions><AdditionalOptions>/MP /bigobj</AdditionalOptions><LanguageStandard>stdcpp17</LanguageStandard><WarningLevel>Level"),
        (1 + F.col("p_size") % 4).cast("string"),
        F.lit('</WarningLevel></ClCompile></ItemDefinitionGroup><ItemGroup><ClCompile Include="src\\a.cpp"/><ClCompile Include="src\\b.cpp"><CompileAsManaged>true</CompileAsManaged></ClCompile></ItemGroup></Project>'),
    )
    files = t.part.select(F.concat(F.lit("/r/p"), k, F.lit("/p.vcxproj")).alias("path"), xml.alias("text"))
    out = build.compile_commands(build.projects(files, "Release|x64"))
    return out.select("file", F.array_join("arguments", " ").alias("arguments"))


_SHEETS = {
    "/props/brand.props": '<Project><ImportGroup><Import Project="root.props"/></ImportGroup><PropertyGroup><Extra>brand</Extra></PropertyGroup></Project>',
    "/props/root.props": '<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><Import Project="BRAND.props"/>'
    "<PropertyGroup><RootProjectDir>$(MSBuildProjectDirectory)\\..\\</RootProjectDir></PropertyGroup>"
    "<PropertyGroup Condition=\"!Exists('$(RootProjectDir)marker.txt')\"><RootProjectDir>$(RootProjectDir)\\..\\</RootProjectDir></PropertyGroup>"
    "<PropertyGroup Condition=\"'$(Configuration)'=='Debug'\"><RootProjectDir>/wrong</RootProjectDir></PropertyGroup>"
    "<ItemDefinitionGroup><ClCompile><AdditionalIncludeDirectories>$(RootProjectDir)sdk;$(Extra)</AdditionalIncludeDirectories><PreprocessorDefinitions>ROOT</PreprocessorDefinitions></ClCompile></ItemDefinitionGroup></Project>",
}


@query(
    "property_sheets",
    """WITH p AS (SELECT p_partkey AS k, p_size AS z, p_size % 7 <> 0 AS there, CASE WHEN p_partkey % 2 = 0 THEN '/r/p' ELSE '/q/s/p' END || p_partkey AS folder,
      CASE WHEN p_partkey % 2 = 0 THEN '/r/' ELSE '/q/' END AS root FROM part)
    SELECT folder || '/p.vcxproj' AS path,
      CASE WHEN there THEN root || 'sdk;/props/$(Extra);' || root || 'inc/' || z || ';/props/local;' || folder || '/inc;' || root || 'own' ELSE folder || '/inc;' || folder || '/$(RootProjectDir)own' END AS includes,
      CASE WHEN there THEN 'ROOT;SIZE=' || z || ';PLAT=x64;' ELSE '' END || 'K=' || k AS defines, CASE WHEN there THEN '/bigobj ' ELSE '' END || '/w' || k AS options,
      CASE WHEN there THEN '/props/size' || z || '.props;/props/brand.props;/props/root.props' ELSE '' END AS imported FROM p""",
)
def property_sheets(t: Tables) -> DataFrame:
    """A project per part under one of two roots; it imports the sheet of its size, if there is one, which imports another, which imports a third that asks for the second again."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    project = F.concat(
        F.lit('<Project><Import Project="$(VCTargetsPath)\\own.props"/><ImportGroup Condition="\'$(Configuration)|$(Platform)\'==\'Debug|x64\'"><Import Project="/props/brand.props"/></ImportGroup>'
              "<ImportGroup Condition=\"'$(Configuration)|$(Platform)'=='Release|x64'\"><Import Project=\"\\props\\SIZE"), z, F.lit(".props\" Condition=\"exists('/props/size"), z,
        F.lit(".props')\"/></ImportGroup><ItemDefinitionGroup><ClCompile><AdditionalIncludeDirectories>inc;$(RootProjectDir)own</AdditionalIncludeDirectories><PreprocessorDefinitions>K="), k,
        F.lit("</PreprocessorDefinitions><AdditionalOptions>/w"), k, F.lit("</AdditionalOptions></ClCompile></ItemDefinitionGroup></Project>"),
    )
    sheet = F.concat(
        F.lit('<Project><ImportGroup><Import Project="brand.props"/></ImportGroup><PropertyGroup><Level>'), z,
        F.lit("</Level></PropertyGroup><ItemDefinitionGroup><ClCompile><AdditionalIncludeDirectories>$(RootProjectDir)inc\\$(Level);local;%(AdditionalIncludeDirectories)</AdditionalIncludeDirectories>"
              "<PreprocessorDefinitions>SIZE=$(Level);PLAT=$(PlatformShortName)</PreprocessorDefinitions><AdditionalOptions>/bigobj</AdditionalOptions></ClCompile></ItemDefinitionGroup></Project>"),
    )
    folder = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/r/p").otherwise("/q/s/p"), k)
    sized = t.part.where("p_size % 7 <> 0").select(F.concat(F.lit("/props/size"), z, F.lit(".props")).alias("path"), sheet.alias("text")).distinct()
    sheets = sized.unionByName(t.spark.createDataFrame(list(_SHEETS.items()), "path string, text string"))
    listed = t.spark.createDataFrame([("/r/marker.txt",)], "path string")
    out = build.projects(t.part.select(F.concat(folder, F.lit("/p.vcxproj")).alias("path"), project.alias("text")), "Release|x64", sheets, listed)
    return out.select("path", *(F.array_join(c, ";").alias(c) for c in ("includes", "defines", "imported")), "options")


@query(
    "include_log",
    "SELECT 'File:src/p' || p_partkey || '.cpp' AS src, 'File:inc/b' || p_size || '.h' AS dst, 'INCLUDES' AS type FROM part",
)
def include_log(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    log = F.concat(F.lit(". /Repo/inc/b"), F.col("p_size").cast("string"), F.lit(".h\n.. /repo/inc/deep.h\n. /usr/include/stdio.h\nnoise\n"))
    logs = t.part.select(F.concat(F.lit("/repo/src/p"), k, F.lit(".cpp")).alias("file"), log.alias("text"))
    return build.include_edges(logs, "/repo")


_PROJECTS = "SELECT s_suppkey AS k, CASE WHEN s_suppkey > 0 THEN s_suppkey - 1 END AS before FROM supplier"


@query(
    "project_edges",
    f"""WITH p AS ({_PROJECTS}) SELECT 'Project:p' || k AS src, 'File:p' || k || '/src/a.cpp' AS dst, 'PROJECT_CONTAINS' AS type FROM p
    UNION ALL SELECT 'Project:p' || k, 'File:shared/s.cpp', 'PROJECT_CONTAINS' FROM p
    UNION ALL SELECT 'Project:p' || k, 'Project:p' || before, 'PROJECT_DEPENDS_ON' FROM p WHERE before IS NOT NULL
    UNION ALL SELECT 'Project:p' || k, 'Project:named' || (k % 7), 'PROJECT_DEPENDS_ON' FROM p WHERE k % 3 = 0""",
)
def project_edges(t: Tables) -> DataFrame:
    """A project per supplier: a source of its own, a shared one, a managed one, the project before it by solution, another by reference."""
    k = F.col("s_suppkey").cast("string")
    reference = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('<ItemGroup><ProjectReference Include="x"><Name>named'), (F.col("s_suppkey") % 7).cast("string"), F.lit("</Name></ProjectReference></ItemGroup>"))).otherwise("")
    xml = F.concat(
        F.lit("<Project><PropertyGroup><ProjectGuid>{"), _guid("s_suppkey"), F.lit("}</ProjectGuid><RootNamespace>p"), k,
        F.lit('</RootNamespace></PropertyGroup><ItemGroup><ClCompile Include="src\\a.cpp"/><ClCompile Include="..\\shared\\s.cpp"/><ClCompile Include="m.cpp"><CompileAsManaged>true</CompileAsManaged></ClCompile></ItemGroup>'),
        reference, F.lit("</Project>"),
    )
    parsed = build.projects(t.supplier.select(F.concat(F.lit("/repo/p"), k, F.lit("/p.vcxproj")).alias("path"), xml.alias("text")), "Release|x64")
    before = F.when(F.col("s_suppkey") > 0, F.array(F.upper(F.concat(F.lit("abc-"), (F.col("s_suppkey") - 1).cast("string"))))).otherwise(F.array().cast("array<string>"))
    listed = t.supplier.select(F.concat(F.lit("p"), k).alias("name"), F.upper(_guid("s_suppkey")).alias("guid"), before.alias("dependencies"))
    return build.project_graph(parsed, listed, "/repo").edges.select("src", "dst", "type")


def _dump(name: str, k, callee):
    """One function that calls another of its own file."""
    return F.concat(
        F.lit('{"kind":"TranslationUnitDecl","id":"1","inner":[{"kind":"FunctionDecl","id":"2","name":"g'), k, F.lit('"},{"kind":"FunctionDecl","id":"3","name":"' + name), k,
        F.lit('","inner":[{"kind":"CallExpr","id":"4","inner":[{"kind":"DeclRefExpr","id":"5","referencedDecl":{"id":"'), callee, F.lit('","kind":"FunctionDecl"}}]}]}]}'),
    )


@query(
    "clang_incremental",
    """WITH p AS (SELECT p_partkey AS k, 'b' || p_size AS header, p_size % 5 = 0 AS hit FROM part)
    SELECT 'node' AS kind, 'Function:g' || k || ':()' AS a, 'cpp/p' || k || '.cpp' AS b FROM p
    UNION ALL SELECT 'node', 'Function:' || CASE WHEN hit THEN 'h' ELSE 'f' END || k || ':()', 'cpp/p' || k || '.cpp' FROM p
    UNION ALL SELECT 'node', 'File:cpp/p' || k || '.cpp', 'cpp/p' || k || '.cpp' FROM p
    UNION ALL SELECT DISTINCT 'node', 'File:inc/' || header || '.h', 'inc/' || header || '.h' FROM p
    UNION ALL SELECT 'node', 'graph-state', NULL
    UNION ALL SELECT 'CALLS', 'Function:' || CASE WHEN hit THEN 'h' ELSE 'f' END || k || ':()', 'Function:g' || k || ':()' FROM p
    UNION ALL SELECT 'INCLUDES', 'File:cpp/p' || k || '.cpp', 'File:inc/' || header || '.h' FROM p""",
)
def clang_incremental(t: Tables) -> DataFrame:
    """A dump per part; headers of every fifth size change, and with them the dumps of the files that include them."""
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/repo/cpp/p"), k, F.lit(".cpp"))
    header = F.concat(F.lit("inc/b"), F.col("p_size").cast("string"), F.lit(".h"))
    logs = t.part.select("p_size", path.alias("file"), F.concat(F.lit(". /repo/"), header, F.lit("\n")).alias("text"))
    before = steps.clang_ingest(t.part.select(path.alias("path"), _dump("f", k, F.lit("2")).alias("text")), "/repo", logs.select("file", "text"))
    hit = t.part.where("p_size % 5 = 0")
    none = t.spark.createDataFrame([], "file string")
    after = steps.clang_incremental(
        before, hit.select(path.alias("path"), _dump("h", k, F.lit("2")).alias("text")), hit.select(header.alias("file")).distinct(), none, "/repo", "c2",
        logs.where("p_size % 5 = 0").select("file", "text"),
    )
    nodes = after.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("file").alias("b"))
    return nodes.unionByName(after.edges.where("type in ('CALLS', 'INCLUDES')").select(F.col("type").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))
