"""Settings in XML and YAML, read as such."""

from treesift.operators.packages import nuget_sources, project_commands, yarn_runtime


def test_commands_of_projects():
    text = """<?xml version="1.0"?>\n<!-- <Exec Command="no"/> -->\n<Project xmlns="http://x">\n <Target>\n  <Exec\n   Command='a &gt; b' />\n  <exec command="cmd-two"/>\n  <Exec Command=" "/><![CDATA[<Exec Command="d"/>]]>\n </Target>\n</Project>"""
    assert [(r, n) for r, n, _, _ in project_commands("a.csproj", text)] == [("DOTNET-001", 2), ("DOTNET-001", 7)]  # the first line with the command, or else with the element's name
    assert len(list(project_commands("a.csproj", text[: text.index("<exec")] + "<broken"))) == 1  # up to where it ends
    assert list(project_commands("a.props", "<Other><Exec Command='x'/></Other>")) == []
    assert list(project_commands("a.props", "")) == [] and list(project_commands("a.props", "no xml")) == []


def test_sources_of_packages():
    text = """<configuration>
  <packageSources><clear /><add key="One" value="https://one.example/v3"/><add value="http://two.example" key="two"/><add key="d" value="https://api.nuget.org/v3/index.json"/></packageSources>
  <disabledPackageSources><add key="x" value="https://not.example"/></disabledPackageSources>
  <packageSourceMapping><packageSource key="one"><package pattern="*"/></packageSource><packageSource key="two"><package pattern="A.*"/></packageSource></packageSourceMapping>
</configuration>"""
    assert [(n, w) for _, n, _, w in nuget_sources("nuget.config", text)] == [(2, "high"), (2, "high")]
    assert [w for *_, w in nuget_sources("nuget.config", text.replace('pattern="*"', 'pattern="B"'))] == ["medium", "high"]
    assert list(nuget_sources("nuget.config", text[:-5])) == [] and list(nuget_sources("nuget.config", "<other/>")) == []


def test_runtime_of_yarn():
    text = "# yarnPath: no\nplugins:\n  - spec: x # path: y\n    path: '../out.cjs'\n  - {path: b.cjs}\n  - path: ''\nyarnPath: >-\n  .yarn/yarn.cjs\n"
    assert [(r, n, v) for r, n, _, v in yarn_runtime(".yarnrc.yml", text)] == [("YARN-001", 7, ".yarn/yarn.cjs"), ("YARN-002", 4, "../out.cjs"), ("YARN-002", 5, "b.cjs")]
    for text in ("", "a: [", "yarnPath: {a: b}", "plugins: x\nyarnPath: y", "- a"):
        assert list(yarn_runtime(".yarnrc.yml", text)) == []
