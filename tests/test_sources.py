"""Configuration and dimension files, which need no Spark session."""

import json

import pytest

from rookery.functions.net import cidr_range, key_of
from rookery.plans.rules import RuleError
from rookery.sources import config, logs


def test_configuration(tmp_path):
    (tmp_path / "more.yaml").write_text("vars:\n  LIST: 'file:list.txt'\nextra: 1\n")
    (tmp_path / "list.txt").write_text("10.0.0.0/8\n# no\n192.168.0.0/16\n")
    (tmp_path / "c.yaml").write_text("include: more.yaml\nvars:\n  net:\n    HOME: 172.16.0.0/12\nclassification: class.config\nrules-files:\n  - a.rules\n")
    (tmp_path / "class.config").write_text("# x\nconfig classification: misc,Some, thing,3\n".replace("Some, thing", "Something"))
    (tmp_path / "a.rules").write_text('alert any $HOME any -> any any (msg:"a"; classtype: misc; sid:1; rev:1;)\n')
    cfg = config.load_config(str(tmp_path / "c.yaml"))
    assert cfg["extra"] == 1 and cfg["vars"]["HOME"] == "172.16.0.0/12" and "192.168.0.0/16" in cfg["vars"]["LIST"]
    assert config.validate(str(tmp_path / "c.yaml")) == 1
    (tmp_path / "a.rules").write_text('alert any any any -> any any (msg:"a"; classtype: other; sid:1; rev:1;)\n')
    with pytest.raises(RuleError):
        config.validate(str(tmp_path / "c.yaml"))


def test_dimension_files(tmp_path):
    f = tmp_path / "f"
    f.write_text("config classification: a,An a,2\n")
    assert config.classifications(str(f)) == [("a", "An a", 2)]
    f.write_text("config classification: a,An a,0\n")
    with pytest.raises(ValueError):
        config.classifications(str(f))
    f.write_text("config reference: url,http://\n")
    assert config.references(str(f)) == [("url", "http://")]
    f.write_text("\n".join(json.dumps(x) for x in ({"type": "message", "protocol_number": 6, "case_sensitive": "true", "string": "TCP"}, {"type": "program", "protocol_number": "17", "string": "named"})))
    assert config.protocol_map(str(f)) == ([("TCP", 6, False)], [("named", 17, True)])
    f.write_text("# c\n1.2.3.4 x\n5.6.0.0/16\n")
    assert config.blacklist(str(f)) == [("1.2.3.4",), ("5.6.0.0/16",)]
    f.write_text("1|Scanner\n")
    assert config.categories(str(f)) == {"scanner": 1}
    assert logs.load_json_map('{"software":"d","syslog-source-ip":".H","message":".A|.B"}', "d") == {"host": [".H"], "message": [".A", ".B"]}


def test_keys_of_addresses():
    assert cidr_range("10.0.0.0/8") == ("40a000000", "40affffff") and key_of("::ffff:1.2.3.4") == key_of("1.2.3.4")
    lo, hi = cidr_range("fe80::/10")
    assert lo <= key_of("fe80::1") <= hi and not lo <= key_of("1.1.1.1") <= hi
